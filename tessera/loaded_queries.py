"""Named queries on loaded stores, with the DuckDB statement that gives the same rows. The quads are made of the test tables, written as text and loaded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import shared_folder
from tessera.sources.loader import load_quads
from tessera.store import QuadStore
from tessera.terms import Iri

PREFIXES = "PREFIX e: <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
GRAPH = "http://e/graph"
XSD = "http://www.w3.org/2001/XMLSchema#"

_stores: dict[tuple[str, str], str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customer_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of N-Quads: times with and without offsets, whole numbers beyond 64 bits, numbers of two types, links to themselves."""
    k = F.col("c_custkey").cast("string")
    s = F.concat(F.lit("<http://e/customer/"), k, F.lit(">"))
    quote = lambda c, dt=None: F.concat(F.lit('"'), c, F.lit(f'"^^<{XSD}{dt}>' if dt else '"'))
    time = F.date_format(F.lit("2000-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("c_custkey").cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    offset = F.element_at(F.array(F.lit(""), F.lit("Z"), F.lit("+05:00")), (F.col("c_custkey") % 3 + 1).cast("int"))
    objects: dict[str, Column] = {
        "name": quote(F.col("c_name")), "nation": F.concat(F.lit("<http://e/nation/"), F.col("c_nationkey").cast("string"), F.lit(">")), "balance": quote(F.col("c_acctbal").cast("string"), "double"),
        "time": quote(F.concat(time, offset), "dateTime"), "big": quote(F.concat(F.lit("1000000000000"), F.lpad(k, 10, "0")), "integer"),
        "mixed": F.when(F.col("c_custkey") % 2 == 0, quote(k, "integer")).otherwise(quote(F.concat(k, F.lit(".5")), "decimal")),
        "self": F.concat(F.lit("<http://e/customer/"), F.when(F.col("c_custkey") % 2 == 0, k).otherwise(F.lit("none")), F.lit(">")),
    }
    graph = F.concat(F.lit("<http://e/g"), (F.col("c_custkey") % 4).cast("string"), F.lit(">"))
    lines = [F.concat_ws(" ", s, F.lit(f"<http://e/{p}>"), o, graph, F.lit(".")) for p, o in objects.items()]
    return _table(spark, sf_dir, "customer").select(F.explode(F.array(*lines)).alias("value"))


def customers(spark: SparkSession, sf_dir: str) -> QuadStore:
    """The store of the customers' quads, loaded once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        folder = shared_folder(spark)
        _customer_quads(spark, sf_dir).write.text(f"{folder}/customers.nq")
        _stores[key] = load_quads(spark, [(f"{folder}/customers.nq", GRAPH)], f"{folder}/store")
    return QuadStore.open(spark, _stores[key])


def _select(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: customers(spark, sf_dir).sparql(PREFIXES + text)


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).statements(p=Iri("http://e/nation"), graphs=["http://e/g1", "http://e/g2"])


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = customers(spark, sf_dir)
    return spark.createDataFrame([("all", store.size()), ("one", store.size(["http://e/g1"]))], "graphs string, n long")


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).sparql(PREFIXES + "SELECT ?s ?n WHERE { ?s e:nation ?k ; e:name ?n }", bindings={"k": Iri("http://e/nation/7")})


def _nation_file(spark: SparkSession, sf_dir: str, name: str, head: str, line: Column, tail: str, codec: str = "none") -> DataFrame:
    """The nations (25 rows) as one file of a syntax, loaded, and counted by predicate."""
    folder = shared_folder(spark)
    body = _table(spark, sf_dir, "nation").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    body.select(F.concat(F.lit(head + "\n"), "body", F.lit("\n" + tail)).alias("value")).coalesce(1).write.option("compression", codec).text(f"{folder}/{name}")
    store = QuadStore.open(spark, load_quads(spark, [(f"{folder}/{name}", GRAPH)], f"{folder}/store"))
    return store.sparql("SELECT ?p (COUNT(*) AS ?n) (COUNT(DISTINCT ?o) AS ?values) WHERE { ?s ?p ?o } GROUP BY ?p")


def _turtle(spark: SparkSession, sf_dir: str, name: str = "nations.ttl", codec: str = "none") -> DataFrame:
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    line = F.concat(F.lit("e:n"), k, F.lit(" a e:Nation ; e:name \""), F.col("n_name"), F.lit("\"@en ; e:region e:r"), r, F.lit(" ; e:key "), k, F.lit(" ."))
    return _nation_file(spark, sf_dir, name, "@prefix e: <http://e/> .", line, "# end", codec)


def _rdf_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    line = F.concat(F.lit('<e:Nation rdf:about="http://e/n'), k, F.lit('"><e:name xml:lang="en">'), F.col("n_name"), F.lit('</e:name><e:region rdf:resource="http://e/r'), r, F.lit(f'"/><e:key rdf:datatype="{XSD}integer">'), k, F.lit("</e:key></e:Nation>"))
    return _nation_file(spark, sf_dir, "nations.rdf", '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/">', line, "</rdf:RDF>")


def _turtle_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turtle(spark, sf_dir, "nations.ttl.gz", "gzip")


_S = "'http://e/customer/' || c_custkey"
_TIME = "TIMESTAMP '2000-01-01' + to_minutes(c_custkey)"
_LOADED = """
SELECT * FROM (VALUES ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM nation), 1), ('http://e/name', (SELECT count(*) FROM nation), (SELECT count(DISTINCT n_name) FROM nation)),
 ('http://e/region', (SELECT count(*) FROM nation), (SELECT count(DISTINCT n_regionkey) FROM nation)), ('http://e/key', (SELECT count(*) FROM nation), (SELECT count(DISTINCT n_nationkey) FROM nation))) t(p, n, "values")
"""

#: name: (function, DuckDB)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "loaded_star": (_select("SELECT ?s ?n ?k ?b WHERE { ?s e:name ?n ; e:nation ?k ; e:balance ?b FILTER(?b > 0) }"), f"SELECT {_S} AS s, c_name AS n, 'http://e/nation/' || c_nationkey AS k, c_acctbal AS b FROM customer WHERE c_acctbal > 0"),
    "loaded_seek_o": (_select("SELECT ?s WHERE { ?s e:nation <http://e/nation/7> }"), f"SELECT {_S} AS s FROM customer WHERE c_nationkey = 7"),
    "loaded_counts": (_select("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p"), "SELECT 'http://e/' || unnest(['name', 'nation', 'balance', 'time', 'big', 'mixed', 'self']) AS p, count(*) AS n FROM customer GROUP BY 1"),
    "loaded_graphs": (_select("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s e:name ?x } } GROUP BY ?g"), "SELECT 'http://e/g' || (c_custkey % 4) AS g, count(*) AS n FROM customer GROUP BY 1"),
    "same_variable": (_select("SELECT ?x WHERE { ?x e:self ?x }"), f"SELECT {_S} AS x FROM customer WHERE c_custkey % 2 = 0"),
    "datetime_offset": (
        _select('SELECT ?z (COUNT(*) AS ?n) WHERE { ?s e:time ?t FILTER(?t >= "2000-01-01T02:00:00Z"^^xsd:dateTime) BIND(TZ(?t) AS ?z) } GROUP BY ?z'),
        f"SELECT ['', 'Z', '+05:00'][c_custkey % 3 + 1] AS z, count(*) AS n FROM customer WHERE {_TIME} - to_hours(CASE c_custkey % 3 WHEN 2 THEN 5 ELSE 0 END) >= TIMESTAMP '2000-01-01 02:00:00' GROUP BY 1",
    ),
    "tz": (
        _select("SELECT ?s (TZ(?t) AS ?z) (TIMEZONE(?t) AS ?d) (HOURS(?t) AS ?h) (MINUTES(?t) AS ?m) WHERE { ?s e:time ?t }"),
        f"SELECT {_S} AS s, ['', 'Z', '+05:00'][c_custkey % 3 + 1] AS z, [NULL, 'PT0S', 'PT5H'][c_custkey % 3 + 1] AS d, hour({_TIME}) AS h, minute({_TIME}) AS m FROM customer",
    ),
    "big_integer": (_select("SELECT ?s ?i WHERE { ?s e:big ?i FILTER(?i > 10000000000000000000050 && ?i != 10000000000000000000099) }"), f"SELECT {_S} AS s, '1000000000000' || lpad(c_custkey::VARCHAR, 10, '0') AS i FROM customer WHERE c_custkey > 50 AND c_custkey <> 99"),
    "mixed_sum": (
        _select("SELECT ?k (xsd:double(SUM(?m)) AS ?sum) (DATATYPE(SUM(?m)) AS ?d) (COUNT(?m) AS ?n) WHERE { ?s e:mixed ?m ; e:nation ?k } GROUP BY ?k"),
        f"SELECT 'http://e/nation/' || c_nationkey AS k, sum(c_custkey + CASE c_custkey % 2 WHEN 1 THEN 0.5 ELSE 0 END)::DOUBLE AS sum, if(max(c_custkey % 2) = 1, '{XSD}decimal', '{XSD}integer') AS d, count(*) AS n FROM customer GROUP BY 1",
    ),
    "statements": (_statements, f"SELECT {_S} AS s, 'http://e/nation' AS p, 'http://e/nation/' || c_nationkey AS o FROM customer WHERE c_custkey % 4 IN (1, 2)"),
    "sizes": (_sizes, "SELECT 'all' AS graphs, count(*) * 7 AS n FROM customer UNION ALL SELECT 'one', count(*) * 7 FROM customer WHERE c_custkey % 4 = 1"),
    "bindings": (_bound, f"SELECT {_S} AS s, c_name AS n FROM customer WHERE c_nationkey = 7"),
    "load_turtle": (_turtle, _LOADED),
    "load_rdf_xml": (_rdf_xml, _LOADED),
    "load_compressed": (_turtle_gz, _LOADED),
}
