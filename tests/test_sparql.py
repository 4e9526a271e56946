"""SPARQL semantics on a small store, against what the recommendation says."""

import pytest

from tessera.results import csv, json_lines, solutions, tsv, xml_text
from tessera.sparql.parser import SparqlError, parse
from tessera.store import QuadStore
from tessera.terms import Iri

DATA = """<http://e/a> <http://e/knows> <http://e/b> .
<http://e/b> <http://e/knows> <http://e/c> .
<http://e/c> <http://e/knows> <http://e/a> .
<http://e/c> <http://e/knows> <http://e/d> .
<http://e/a> <http://e/name> "Ann"@en .
<http://e/b> <http://e/name> "Bob, \\"B\\"" .
<http://e/a> <http://e/age> "30"^^<http://www.w3.org/2001/XMLSchema#int> .
<http://e/b> <http://e/age> "31.5"^^<http://www.w3.org/2001/XMLSchema#decimal> .
<http://e/c> <http://e/age> "old" .
<http://e/d> <http://e/score> "NaN"^^<http://www.w3.org/2001/XMLSchema#double> .
<http://e/d> <http://e/born> "2001-02-03T04:05:06.5Z"^^<http://www.w3.org/2001/XMLSchema#dateTime> .
"""
P = "PREFIX e: <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    from tessera.sources.loader import load_quads

    folder = tmp_path_factory.mktemp("sparql")
    (folder / "a.nt").write_text(DATA)
    return QuadStore.open(spark, load_quads(spark, [(str(folder / "a.nt"), "http://e/g")], f"file://{folder}/store"))


def got(store, text, **kw):
    return sorted(map(tuple, store.sparql(P + text, **kw).collect()), key=str)


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("SELECT ?o WHERE { e:a e:knows+ ?o }", [("http://e/a",), ("http://e/b",), ("http://e/c",), ("http://e/d",)]),
        ("SELECT ?o WHERE { e:zz e:knows* ?o }", [("http://e/zz",)]),
        ("SELECT ?s WHERE { ?s e:knows+ e:d }", [("http://e/a",), ("http://e/b",), ("http://e/c",)]),
        ("SELECT ?x WHERE { ?x e:knows+ ?x }", [("http://e/a",), ("http://e/b",), ("http://e/c",)]),
        ("SELECT ?s WHERE { ?s e:age ?x FILTER(?x > 30) }", [("http://e/b",)]),
        ("SELECT ?s WHERE { ?s e:age ?x FILTER(!(?x > 30)) }", [("http://e/a",)]),
        ("SELECT ?s WHERE { ?s e:age ?x FILTER(?x = 30) }", [("http://e/a",)]),
        ("SELECT ?s WHERE { ?s e:age ?x FILTER(isNumeric(?x)) }", [("http://e/a",), ("http://e/b",)]),
        ('SELECT ?s WHERE { ?s e:name ?n FILTER(LANG(?n) = "en") }', [("http://e/a",)]),
        ("SELECT ?s WHERE { ?s e:score ?n FILTER(?n > 1 || ?n <= 1) }", []),
        ("SELECT (SUM(?x) AS ?n) WHERE { ?s e:age ?x FILTER(isNumeric(?x)) }", [("61.5",)]),
        ("SELECT ?s ?n WHERE { ?s e:knows ?x OPTIONAL { ?s e:name ?n } }", [("http://e/a", "Ann"), ("http://e/b", 'Bob, "B"'), ("http://e/c", None), ("http://e/c", None)]),
        ("SELECT ?s WHERE { ?s e:knows ?x OPTIONAL { ?s e:name ?n } FILTER(!BOUND(?n)) }", [("http://e/c",), ("http://e/c",)]),
        ("SELECT ?s ?n WHERE { VALUES ?s { e:a e:c } OPTIONAL { ?s e:name ?n } ?t e:name ?n }", [("http://e/a", "Ann"), ("http://e/c", "Ann"), ("http://e/c", 'Bob, "B"')]),
        ("SELECT ?s ?n ?a WHERE { VALUES ?s { e:a e:c } OPTIONAL { ?s e:name ?n } OPTIONAL { ?t e:name ?n ; e:age ?a } }", [("http://e/a", "Ann", "30"), ("http://e/c", "Ann", "30"), ("http://e/c", 'Bob, "B"', "31.5")]),
        ("SELECT ?s WHERE { ?s e:knows ?o MINUS { ?s e:name ?n } }", [("http://e/c",), ("http://e/c",)]),
        ("SELECT ?s WHERE { ?s e:name ?n FILTER EXISTS { ?s e:knows ?o . ?o e:name ?m } }", [("http://e/a",)]),
        ("SELECT ?p WHERE { e:d ?p ?o }", [("http://e/born",), ("http://e/score",)]),
        ("SELECT ?x WHERE { BIND(1/0 AS ?x) }", [(None,)]),
        ("SELECT ?x WHERE { BIND(1e0/0 AS ?x) }", [(float("inf"),)]),
        ("SELECT ?x WHERE { BIND(COALESCE(1/0, 5) AS ?x) }", [("5",)]),
        ('SELECT ?x WHERE { BIND(SUBSTR("abcde", 0, 3) AS ?x) }', [("ab",)]),
        ('SELECT ?x WHERE { BIND(STRBEFORE("abc", "z") AS ?x) }', [("",)]),
        ('SELECT ?x WHERE { BIND("1" = 1 AS ?x) }', [(None,)]),
        ('SELECT ?x WHERE { BIND(xsd:integer("x") AS ?x) }', [(None,)]),
        ("SELECT ?x WHERE { BIND(ROUND(-2.5) AS ?x) }", [(-2.0,)]),
        ("SELECT ?y WHERE { e:d e:born ?b BIND(YEAR(?b) * 100 + MONTH(?b) AS ?y) }", [(200102,)]),
        ("SELECT ?s (COUNT(?o) AS ?n) WHERE { ?s e:knows ?o } GROUP BY ?s HAVING(COUNT(?o) > 1)", [("http://e/c", 2)]),
        ("SELECT ?o WHERE { e:a ^e:knows/e:knows ?o }", [("http://e/a",), ("http://e/d",)]),
        ("SELECT ?x WHERE { { SELECT ?x WHERE { ?x e:knows ?y } ORDER BY ?x LIMIT 1 } }", [("http://e/a",)]),
    ],
)
def test_semantics(store, text, wanted):
    assert got(store, text) == sorted(wanted, key=str)


def test_order_of_kinds(store):
    shown = [r["x"] for r in store.sparql(P + "SELECT ?x WHERE { { e:a ?p ?x } UNION { e:b ?p ?x } UNION { e:a e:none ?x } } ORDER BY ?x").collect()]
    assert shown == ["http://e/b", "http://e/c", "30", "31.5", "Ann", 'Bob, "B"'] or shown == ["http://e/b", "http://e/c", "30", "31.5", 'Bob, "B"', "Ann"]


def test_bindings_and_forms(store):
    assert got(store, "SELECT ?o WHERE { ?s e:knows ?o }", bindings={"s": Iri("http://e/a")}) == [("http://e/b",)]
    assert got(store, "ASK { e:a e:knows e:b }") == [(True,)] and got(store, "ASK { e:a e:knows e:d }") == [(False,)]
    assert got(store, "CONSTRUCT { ?o e:known ?n } WHERE { ?s e:knows ?o OPTIONAL { ?s e:name ?n } }") == [("<http://e/b>", "<http://e/known>", '"Ann"@en'), ("<http://e/c>", "<http://e/known>", '"Bob, \\"B\\""')]
    assert len(got(store, "DESCRIBE e:a")) == 3
    with pytest.raises(NotImplementedError):
        store.sparql(P + "SELECT ?s WHERE { SERVICE <http://x/> { ?s ?p ?o } }")


def test_result_formats(store):
    df = solutions(store, P + "SELECT ?s ?n WHERE { ?s e:knows ?x OPTIONAL { ?s e:name ?n } } ")
    assert '<http://e/a>\t"Ann"@en' in {r["value"] for r in tsv(df).collect()}
    assert 'http://e/b,"Bob, ""B"""' in {r["value"] for r in csv(df).collect()} and "http://e/c," in {r["value"] for r in csv(df).collect()}
    assert '{"s":{"type":"uri","value":"http://e/a"},"n":{"type":"literal","value":"Ann","xml:lang":"en"}}' in {r["value"] for r in json_lines(df).collect()}
    assert 'xml:lang="en">Ann</literal>' in xml_text(df)


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?x { ?x }", "SELECT ?x WHERE { ?x e:p ?y }", "SELECT ?x WHERE { ?x <http://p> 'a }"])
def test_syntax_errors(text):
    with pytest.raises(SparqlError):
        parse(text)


def test_star_is_one_scan(spark):
    store = QuadStore.tables(spark, "/root/testdata/sf0.001")
    plan = store.sparql('PREFIX v: <http://ex.org/v#> SELECT ?q ?p WHERE { ?l v:l_quantity ?q ; v:l_extendedprice ?p ; v:l_returnflag "R" }')._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "EqualTo(l_returnflag" in plan
