"""Loading and scanning: the small data sets of the plan's test strategy."""

import bz2
import gzip
import lzma

import pytest

from tessera.sources.loader import LoadError, load_quads, read_quads
from tessera.sources.rdf import RdfError, Turtle, parse_file, rdf_xml, syntax_of
from tessera.store import QuadStore, ReadOnlyError
from tessera.terms import BOOLEAN, GYEAR, LANG_STRING, RDF_TYPE, XSD, BNode, Iri, Lit, n_triples, parse_term

RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
BAG, ALT = "http://example.org/Bag", "http://example.org/Alt"
GRAPH = "http://example.org/graph"
TINY = f"""<{BAG}> <{RDF_TYPE}> <{ALT}> .
<{ALT}> <{RDF_TYPE}> <{BAG}> .
<{ALT}> <{RDF_TYPE}> <{ALT}> .
<{ALT}> <{RDFS_LABEL}> "true"^^<{BOOLEAN}> .
<{ALT}> <{RDFS_LABEL}> "\\u676D\\u5DDE\\u5E02" . # a comment
<{ALT}> <{RDFS_LABEL}> _:1 .
"""


def stored(spark, tmp_path, text, name="a.nt", **kw):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return QuadStore.open(spark, load_quads(spark, [(str(path), GRAPH)], f"file://{tmp_path}/store", **kw))


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("tiny"), TINY)


def test_tiny_scans(tiny):
    label, a = Iri(RDFS_LABEL), Iri(RDF_TYPE)
    assert tiny.statements(p=a).count() == 3
    assert tiny.statements(p=a, o=Iri(ALT)).count() == 2
    assert tiny.statements(p=a, o=Iri(BAG)).count() == 1
    assert tiny.statements(p=label).count() == 3
    assert tiny.statements(Iri(ALT), label, Lit("true", BOOLEAN)).count() == 1
    assert tiny.statements(Iri(ALT), label, Lit("杭州市")).count() == 1
    assert tiny.statements(Iri(ALT), label, Lit("true")).count() == 0
    assert tiny.size() == 6
    assert tiny.size([GRAPH]) == 6 and tiny.size(["http://example.org/other"]) == 0
    assert [r["graph"] for r in tiny.graphs().collect()] == [GRAPH]
    assert {r["predicate"]: r["triples"] for r in tiny.statistics().collect()} == {RDF_TYPE: 3, RDFS_LABEL: 3}


def test_tiny_queries(tiny):
    p = f"PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> SELECT ?l WHERE {{ <{ALT}> rdfs:label ?l "
    assert tiny.sparql(p + "FILTER(isBlank(?l)) }").count() == 1
    assert sorted(r["l"] for r in tiny.sparql(p + "FILTER(isLiteral(?l)) }").collect()) == ["true", "杭州市"]
    both = f"SELECT ?a ?b WHERE {{ <{ALT}> <{RDFS_LABEL}> ?a . <{ALT}> <{RDFS_LABEL}> ?b }}"
    assert tiny.sparql(both).count() == 9
    assert tiny.sparql(f"SELECT ?x WHERE {{ ?x a ?x }}").collect()[0]["x"] == ALT


def test_read_only(tiny):
    with pytest.raises(ReadOnlyError):
        tiny.add()


def test_many_and_years(spark, tmp_path):
    lines = []
    for i in range(1000, 2000):
        s = f"<http://example.org/iri/{i}>"
        lines += [f"{s} <{RDF_TYPE}> <{BAG}> .", f"{s} <{RDF_TYPE}> <{ALT}> .", f'{s} <{RDFS_LABEL}> "{i}"^^<{GYEAR}> .', f'{s} <{RDFS_LABEL}> "hello"@en-UK .']
    store = stored(spark, tmp_path, "\n".join(lines))
    count = lambda w: store.sparql(f"SELECT (COUNT(?s) AS ?n) WHERE {{ {w} }}").collect()[0]["n"]
    assert count(f"?s a <{ALT}>") == count(f"?s a <{BAG}>") == count(f"?s a <{ALT}> . ?s a <{BAG}>") == 1000
    years = store.sparql(f"SELECT ?y WHERE {{ ?s <{RDFS_LABEL}> ?y FILTER(DATATYPE(?y) = <{GYEAR}>) }} ORDER BY ?y")
    assert [r["y"] for r in years.collect()] == [str(i) for i in range(1000, 2000)]
    assert count(f'?s <{RDFS_LABEL}> "hello"@EN-uk') == 1000
    assert count(f'?s <{RDFS_LABEL}> ?l FILTER(langMatches(LANG(?l), "en"))') == 1000
    ordered = store.statements(p=Iri(RDF_TYPE), o=Iri(ALT), ordered=True)
    assert [r["s"] for r in ordered.take(2)] == ["http://example.org/iri/1000", "http://example.org/iri/1001"]


def test_values_are_terms(spark, tmp_path):
    text = f'<http://e/a> <http://e/p> "007"^^<{XSD}int> .\n<http://e/a> <http://e/p> "7"^^<{XSD}int> .\n_:b <http://e/p> _:b .\n_:c <http://e/p> "x"^^<http://e/own> .'
    store = stored(spark, tmp_path, text)
    assert store.size() == 3
    assert store.sparql("SELECT ?s WHERE { ?s <http://e/p> ?s }").count() == 1
    assert [r["o"] for r in store.statements(s=None, p=Iri("http://e/p"), o=Lit("x", "http://e/own")).collect()] == ["x"]


WIDE = f"""<http://e/a> <http://e/t> "2001-02-03T04:05:06Z"^^<{XSD}dateTime> .
<http://e/a> <http://e/t> "2001-02-03T04:05:06+05:00"^^<{XSD}dateTime> .
<http://e/a> <http://e/t> "2001-02-03T04:05:06"^^<{XSD}dateTime> .
<http://e/b> <http://e/t> "2001-02-03T09:05:06+05:00"^^<{XSD}dateTime> .
<http://e/a> <http://e/n> "123456789012345678901"^^<{XSD}integer> .
<http://e/a> <http://e/n> "123456789012345678902"^^<{XSD}integer> .
<http://e/a> <http://e/n> "5"^^<{XSD}integer> .
<http://e/a> <http://e/d> "0.12345678901234567891"^^<{XSD}decimal> .
<http://e/a> <http://e/d> "0.12345678901234567892"^^<{XSD}decimal> .
<http://e/a> <http://e/m> "1"^^<{XSD}integer> .
<http://e/a> <http://e/m> "0.5"^^<{XSD}decimal> .
"""


def test_no_term_is_lost(spark, tmp_path):
    """Values that no native column holds stay terms of their own, and compare by value."""
    store = stored(spark, tmp_path, WIDE)
    assert store.size() == 11 == store.statements().count()
    select = lambda text: sorted(map(tuple, store.sparql(f"PREFIX xsd: <{XSD}> {text}").collect()), key=str)
    assert select("SELECT ?s (TZ(?t) AS ?z) (HOURS(?t) AS ?h) WHERE { ?s <http://e/t> ?t }") == sorted([("http://e/a", "Z", 4), ("http://e/a", "+05:00", 4), ("http://e/a", "", 4), ("http://e/b", "+05:00", 9)], key=str)
    assert len(select('SELECT ?s WHERE { ?s <http://e/t> ?t FILTER(?t = "2001-02-03T04:05:06Z"^^xsd:dateTime) }')) == 3  # of the same instant
    assert select('SELECT ?s WHERE { ?s <http://e/t> "2001-02-03T04:05:06Z"^^xsd:dateTime }') == [("http://e/a",)]
    assert select('SELECT ?s WHERE { ?s <http://e/t> "2001-02-03T04:05:06"^^xsd:dateTime }') == [("http://e/a",)]
    assert select('SELECT (TIMEZONE(?t) AS ?z) WHERE { ?s <http://e/t> ?t FILTER(TZ(?t) = "+05:00") }') == [("PT5H",), ("PT5H",)]
    assert select('SELECT ?x WHERE { BIND("04:05" AS ?y) BIND(xsd:dateTime("2001-02-03T04:05:06Z") = xsd:dateTime("2001-02-03T05:05:06+01:00") AS ?x) }') == [(True,)]
    assert select("SELECT ?n WHERE { ?s <http://e/n> ?n FILTER(?n > 123456789012345678901) }") == [("123456789012345678902",)]
    assert select("SELECT ?s WHERE { ?s <http://e/n> 123456789012345678901 }") == [("http://e/a",)]
    assert select("SELECT ?n WHERE { ?s <http://e/n> ?n } ORDER BY ?n LIMIT 1") == [("5",)]
    assert select("SELECT (COUNT(DISTINCT ?d) AS ?n) WHERE { ?s <http://e/d> ?d }") == [(2,)]
    assert select("SELECT (SUM(?m) AS ?t) (DATATYPE(SUM(?m)) AS ?d) (AVG(?m) AS ?a) WHERE { ?s <http://e/m> ?m }") == [("1.5", XSD + "decimal", "0.75")]
    assert select("SELECT (DATATYPE(?m + ?m) AS ?d) (?m * 2 AS ?x) (-?m AS ?y) WHERE { ?s <http://e/m> ?m }") == sorted([(XSD + "integer", "2", "-1"), (XSD + "decimal", "1.0", "-0.5")])


def test_empty_store(spark, tmp_path):
    store = stored(spark, tmp_path, "# nothing\n")
    assert store.size() == 0 and store.statements().count() == 0 and store.graphs().count() == 0 and store.statistics().count() == 0
    assert store.sparql("SELECT ?s WHERE { ?s ?p ?o }").count() == 0 and store.sparql("SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }").collect()[0]["n"] == 0


def test_stars_of_a_loaded_store_need_no_shuffle(spark, tmp_path):
    lines = "".join(f'<http://e/{i}> <http://e/p> "{i}" .\n<http://e/{i}> <http://e/q> "{i % 7}" .\n<http://e/{i}> <http://e/r> <http://e/{i % 5}> .\n' for i in range(500))
    store = stored(spark, tmp_path, lines, buckets=4)
    assert not any((tmp_path / "store" / "stage1").rglob("*"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = store.sparql("SELECT ?s ?a ?b ?c WHERE { ?s <http://e/p> ?a ; <http://e/q> ?b ; <http://e/r> ?c }")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        assert df.count() == 500 and {(r["s"], r["a"], r["b"], r["c"]) for r in df.collect()} == {(f"http://e/{i}", str(i), str(i % 7), f"http://e/{i % 5}") for i in range(500)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # a seek by object is pushed to the scan, where the files' Bloom filters serve it
    seek = store.sparql('SELECT ?s WHERE { ?s <http://e/p> "77" }')
    assert "EqualTo(o_text,77)" in seek._jdf.queryExecution().executedPlan().toString() and [r["s"] for r in seek.collect()] == ["http://e/77"]
    assert {p.predicate: (p.rows, p.objects) for p in store.partitions()} == {"http://e/p": (500, pytest.approx(500, rel=0.1)), "http://e/q": (500, 7), "http://e/r": (500, 5)}


def test_command_line(spark, tmp_path, capsys):
    from tessera.sources.loader import main

    (tmp_path / "a.nt").write_text(TINY)
    (tmp_path / "bad.nt").write_text(f'<http://e/a> <http://e/p> "S"^^<{XSD}int> .')
    (tmp_path / "ok").write_text(f"{tmp_path}/a.nt\t{GRAPH}\n")
    (tmp_path / "value").write_text(f"{tmp_path}/bad.nt\t{GRAPH}\n")
    (tmp_path / "graph").write_text(f"{tmp_path}/a.nt\tnot a graph:\n")
    (tmp_path / "kind").write_text(f"{tmp_path}/a.csv\t{GRAPH}\n")
    (tmp_path / "row").write_text("x\n")
    codes = [main([f"file://{tmp_path}/{m}", f"file://{tmp_path}/out-{m}", "0", ".zstd"]) for m in ("ok", "value", "graph", "kind", "row")]
    assert codes == [0, 12, 10, 1, 7]
    assert QuadStore.open(spark, f"file://{tmp_path}/out-ok").size() == 6


def test_bad_values_and_graphs(spark, tmp_path):
    with pytest.raises(Exception, match="not a value"):
        stored(spark, tmp_path, f'<http://e/a> <http://e/p> "S"^^<{XSD}int> .')
    (tmp_path / "loose").mkdir()
    assert stored(spark, tmp_path / "loose", f'<http://e/a> <http://e/p> "S"^^<{XSD}int> .\nrubbish\n<http://e/a> <http://e/p> 7 .\n<http://e/a> <http://e/p> "7"^^<{XSD}int> .', strict=False).size() == 1
    with pytest.raises(LoadError) as e:
        load_quads(spark, [("file.txt", GRAPH)], str(tmp_path / "none"))
    assert e.value.code == 1
    (tmp_path / "manifest").write_text("only one column\n")
    with pytest.raises(LoadError) as e:
        load_quads(spark, str(tmp_path / "manifest"), str(tmp_path / "none"))
    assert e.value.code == 7


def test_graphs(spark, tmp_path):
    quads = "".join(f"<http://e/{i}> <http://e/p> <http://e/o> <http://e/g{i % 4}> .\n" for i in range(40)) + "<http://e/0> <http://e/p> <http://e/o> <http://e/g1> .\n"
    store = stored(spark, tmp_path, quads, "a.nq")
    assert store.size() == 40
    assert [store.size([f"http://e/g{i}"]) for i in range(4)] == [10, 11, 10, 10]
    assert store.size(["http://e/g0", "http://e/g1"]) == 20
    assert store.size(["http://e/g0", "http://e/none"]) == 10
    assert store.size([None]) == 40
    got = store.sparql("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g ORDER BY ?g")
    assert [r["n"] for r in got.collect()] == [10, 11, 10, 10]
    assert store.sparql("SELECT ?s FROM <http://e/g0> FROM <http://e/g1> WHERE { ?s <http://e/p> ?o }").count() == 20
    assert store.sparql("SELECT ?s FROM NAMED <http://e/g2> WHERE { GRAPH ?g { ?s <http://e/p> ?o } }").count() == 10


TURTLE = """@prefix e: <http://e/> . @base <http://base/x> .
e:a a e:T ; e:p 1, 2.5, 1e3, true, "hi"@en, 'long\\n', <rel> ; e:q [ e:r ( e:x "y"^^e:dt ) ] .
[] e:p \"\"\"two "lines"
here\"\"\" .
"""


def test_turtle():
    quads = list(Turtle(TURTLE).quads())
    assert len(quads) == 15
    objects = [q[2] for q in quads if isinstance(q[2], Lit)]
    assert Lit("1", XSD + "integer") in objects and Lit("long\n") in objects and Lit('two "lines"\nhere') in objects
    assert Iri("http://base/rel") in [q[2] for q in quads]
    trig = list(Turtle("@prefix e: <http://e/> . e:g { e:a e:b e:c . } GRAPH e:h { e:a e:b 'c' } { e:a e:b e:d }").quads())
    assert [q[3] for q in trig] == ["http://e/g", "http://e/h", None]
    with pytest.raises(RdfError):
        list(Turtle("e:a e:b e:c .").quads())


RDFXML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://base/">
 <e:T rdf:about="a" e:own="attr"><e:p xml:lang="EN">hi</e:p><e:n rdf:datatype="http://www.w3.org/2001/XMLSchema#int">5</e:n>
  <e:q rdf:resource="b"/><e:r><rdf:Description rdf:nodeID="z"><e:p>x</e:p></rdf:Description></e:r>
  <e:s rdf:parseType="Resource"><e:p>y</e:p></e:s><e:c rdf:parseType="Collection"><e:T rdf:about="c"/></e:c></e:T>
 <rdf:Bag rdf:ID="bag"><rdf:li>1</rdf:li><rdf:li>2</rdf:li></rdf:Bag>
</rdf:RDF>"""


def test_turtle_in_pieces():
    """The same statements whatever the pieces, and nothing is held but what is being read."""
    text = TURTLE + "".join(f'e:s{i} e:p """long ""text"" {i}\n""" , "" , e:o{i} .\n' for i in range(3000))
    whole = list(Turtle(text).quads())
    for size in (1, 7, 1000):
        own = Turtle(text[i : i + size] for i in range(0, len(text), size))
        held, got = 0, []
        for q in own.quads():
            got.append(q)
            held = max(held, len(own.text))
        assert got == whole and held < 4 * Turtle.AHEAD


def test_rdf_xml_in_pieces():
    """A long file gives its statements as it is read."""
    node = '<e:T rdf:about="http://e/{}"><e:p>some text</e:p></e:T>'
    read = 0

    def data():
        nonlocal read
        yield b'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/">'
        for i in range(20_000):
            read += 1
            yield node.format(i).encode()
        yield b"</rdf:RDF>"

    ahead = 0
    for k, _ in enumerate(rdf_xml(data())):
        ahead = max(ahead, read - k // 2)
    assert k == 39_999 and ahead < 2000


def test_ordered_files(spark, tmp_path):
    """Files that are split for reading are parsed in their order."""
    body = "".join(f'e:s{i} e:p """line {i}\nand more""" ;\n e:q e:o{i} .\n' for i in range(4000))
    for k in range(3):
        (tmp_path / f"{k}.ttl").write_text(f"@prefix e: <http://e{k}/> .\n{body}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_quads(spark, [(f"{tmp_path}/{k}.ttl", f"{GRAPH}{k}") for k in range(3)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3 * 8000 and {(r["s"][8], r["g"][-1]) for r in rows} == {(str(k), str(k)) for k in range(3)} or len({r["g"] for r in rows}) == 3
    assert {r["o_lex"] for r in rows if r["p"] == "http://e1/p"} == {f"line {i}\nand more" for i in range(4000)}


def test_rdf_xml():
    found = {tuple(map(n_triples, q[:3])) for q in parse_file(RDFXML.encode(), "a.rdf", "")}
    a = "<http://base/a>"
    assert (a, "<http://e/p>", '"hi"@en') in found and (a, "<http://e/own>", '"attr"') in found
    assert (a, "<http://e/n>", f'"5"^^<{XSD}int>') in found and (a, "<http://e/q>", "<http://base/b>") in found
    assert ("_:n_z", "<http://e/p>", '"x"') in found
    assert ("<http://base/#bag>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#_2>", '"2"') in found
    assert len(found) == 16


def test_syntaxes_and_codecs(spark, tmp_path):
    assert syntax_of("x/y.nq.gz") == "nquads" and syntax_of("a.owl.xz") == "rdfxml"
    with pytest.raises(RdfError):
        syntax_of("a.csv")
    import pyarrow as pa
    import zstandard

    nt = b"<http://e/a> <http://e/p> _:x .\n"
    framed = pa.BufferOutputStream()
    with pa.CompressedOutputStream(framed, "lz4") as f:
        f.write(TURTLE.encode())
    files = {"a.nt": nt, "b.nt.gz": gzip.compress(nt), "c.nt.bz2": bz2.compress(nt), "d.nt.xz": lzma.compress(nt), "e.ttl": TURTLE.encode(), "f.rdf.gz": gzip.compress(RDFXML.encode()), "g.ttl.zst": zstandard.compress(TURTLE.encode()), "h.ttl.lz4": framed.getvalue().to_pybytes(), "i.nq.zst": zstandard.compress(b'<http://e/a> <http://e/p> "\\u0041\\n"@EN <http://e/g> . # end\n')}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    quads = read_quads(spark, [(f"file:{tmp_path}/{n}", GRAPH) for n in files])
    rows = quads.collect()
    assert len(rows) == 4 + 3 * 15 + 16 + 1
    assert [(r['o_lex'], r['o_lang']) for r in rows if r['g'] == 'http://e/g'] == [('A\n', 'en')]
    assert len({r["o_lex"] for r in rows if r["p"] == "http://e/p" and r["o_kind"] == "bnode"}) == 4  # labels are of their file


def test_intermediate_folders(spark):
    """Under spark.checkpoint.dir; a cluster without one is refused."""
    from types import SimpleNamespace

    from tessera.lineage import discard, settled_with_count, shared_folder

    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    df, n = settled_with_count(spark.range(7))
    assert n == 7 == df.count()
    folder = df.inputFiles()[0].rsplit("/", 1)[0]
    discard(spark, folder)
    assert not [x for x in spark.sparkContext._jvm.java.io.File(folder.replace("file://", "")).list() or []]
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_terms_parse_back():
    for term in (Iri("http://e/a"), Lit("x"), Lit('a "b"\n\\c'), Lit("5", XSD + "int"), Lit("hi", LANG_STRING, "en"), BNode("b1")):
        assert parse_term(n_triples(term)) == term
    with pytest.raises(ValueError):
        parse_term("not a term")


def test_staged_restart(spark, tmp_path):
    (tmp_path / "a.nt").write_text(TINY)
    files, out = [(str(tmp_path / "a.nt"), GRAPH)], f"file://{tmp_path}/store"
    load_quads(spark, files, out, stage=1)
    (tmp_path / "a.nt").unlink()  # what is done is not done again
    assert QuadStore.open(spark, load_quads(spark, files, out)).size() == 6
