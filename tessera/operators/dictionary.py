"""Dictionaries and indexes as DataFrame operators: order-preserving ids, encoding and decoding, distinct merges, inverted index, graph bitmaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.lineage import settled


def merged(runs: list[DataFrame], distinct: bool = True) -> DataFrame:
    """The sorted union of runs of one column each, with or without repeated values. Ranges are sorted apart, then lie in order."""
    rows = reduce(DataFrame.unionAll, runs)
    rows = rows.distinct() if distinct else rows
    return rows.orderBy(*rows.columns)


def dictionary(values: DataFrame, column: str, blocks: int | None = None) -> DataFrame:
    """(id, value): each distinct value with its place in sorted order, from 0. Nulls have no id.

    Two passes: values are ranged into blocks, blocks are counted, and a value's id is its place in its block plus the counts of the blocks
    before. No task sees more than a block.
    """
    spark = values.sparkSession
    own = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(own.repartitionByRange(n, "value").withColumn("block", F.spark_partition_id()))
    counts = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))  # a row for each block
    starts = counts.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("start"))
    within = placed.withColumn("place", F.row_number().over(W.partitionBy("block").orderBy("value")))
    return within.join(starts, "block").select((F.col("start") + F.col("place") - 1).alias("id"), "value")


def encoded(rows: DataFrame, columns: dict[str, DataFrame]) -> DataFrame:
    """Columns replaced by the ids of their dictionaries; null where a value is in none."""
    for name, ids in columns.items():
        rows = rows.join(ids.select(F.col("value").alias(name), F.col("id").alias(f"__{name}")), name, "left").drop(name).withColumnRenamed(f"__{name}", name)
    return rows


def decoded(rows: DataFrame, columns: dict[str, DataFrame]) -> DataFrame:
    """Columns of ids replaced by the values: the last joins of a plan, after filters and joins on ids."""
    for name, ids in columns.items():
        rows = rows.join(ids.select(F.col("id").alias(name), F.col("value").alias(f"__{name}")), name, "left").drop(name).withColumnRenamed(f"__{name}", name)
    return rows


def inverted(rows: DataFrame, key: str, value: str, most: int = 100_000) -> DataFrame:
    """(value, block, keys): the sorted sets of keys of each value, in blocks of about `most` keys, so no row is unbounded."""
    pairs = rows.select(F.col(value).alias("value"), F.col(key).alias("key")).where("key is not null")
    blocks = pairs.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / most).alias("blocks"))
    placed = pairs.join(blocks.withColumnRenamed("value", "__value"), F.col("value").eqNullSafe(F.col("__value"))).select("value", "key", F.pmod(F.xxhash64("key"), "blocks").alias("block"))
    return placed.groupBy("value", "block").agg(F.sort_array(F.collect_set("key")).alias("keys"))


QUAD_TERMS = ("s", "p", "o", "g")


def iri_dictionary(quads: DataFrame) -> DataFrame:
    """(id, value): one dictionary of all IRIs, wherever in a quad they stand. quads as the parsers give them."""
    parts = [quads.select(F.col("s").alias("iri")).where("s_kind = 'iri'"), quads.select(F.col("p").alias("iri")), quads.select(F.col("o_lex").alias("iri")).where("o_kind = 'iri'"), quads.select(F.col("g").alias("iri"))]
    return dictionary(reduce(DataFrame.unionAll, parts), "iri")


def literal_dictionary(quads: DataFrame) -> DataFrame:
    """(o_dt, o_lang, id, value): a dictionary of each type's literals; ids start anew with each."""
    own = quads.where("o_kind = 'literal'").select(F.struct("o_dt", "o_lang", "o_lex").alias("term"))
    ids = dictionary(own, "term").select("id", "value.o_dt", "value.o_lang", F.col("value.o_lex").alias("value"))
    first = ids.groupBy(F.col("o_dt").alias("__dt"), F.col("o_lang").alias("__lang")).agg(F.min("id").alias("first"))
    same = F.col("o_dt").eqNullSafe(F.col("__dt")) & F.col("o_lang").eqNullSafe(F.col("__lang"))
    return ids.join(first, same).select("o_dt", "o_lang", (F.col("id") - F.col("first")).alias("id"), "value")


def encoded_quads(quads: DataFrame, iris: DataFrame, literals: DataFrame) -> DataFrame:
    """Quads of ids: IRIs and literals by their dictionaries, blank nodes by their labels (s_label, o_label)."""
    named = lambda c, out: iris.select(F.col("value").alias(f"__{c}"), F.col("id").alias(out))
    of = lambda kind, c: F.when(F.col(kind) == "iri", F.col(c))
    rows = quads.withColumns({"__s": of("s_kind", "s"), "__p": F.col("p"), "__o": of("o_kind", "o_lex"), "__g": F.col("g")})
    for c, out in (("s", "s_id"), ("p", "p_id"), ("o", "o_iri"), ("g", "g_id")):
        rows = rows.join(named(c, out), f"__{c}", "left")
    lits = literals.select(F.col("o_dt").alias("__dt"), F.col("o_lang").alias("__lang"), F.col("value").alias("__lex"), F.col("id").alias("o_lit"))
    rows = rows.join(lits, (F.col("o_kind") == "literal") & (F.col("o_lex") == F.col("__lex")) & F.col("o_dt").eqNullSafe(F.col("__dt")) & F.col("o_lang").eqNullSafe(F.col("__lang")), "left")
    label = lambda kind, c: F.when(F.col(kind) == "bnode", F.col(c))
    return rows.select("s_id", label("s_kind", "s").alias("s_label"), "p_id", F.coalesce("o_iri", "o_lit").alias("o_id"), label("o_kind", "o_lex").alias("o_label"), "o_kind", "o_dt", "o_lang", "g_id")


#: An inverted form pays where a predicate's values are few and recur.
MOST_VALUES = 32_767


def encoding_choice(rows: DataFrame, predicate: str, subject: str, value: str) -> DataFrame:
    """(predicate, triples, subjects, objects, encoding): `inverted` (value to subjects) where values are few and have two subjects or more each on average, else `sorted`."""
    figures = rows.groupBy(F.col(predicate).alias("predicate")).agg(F.count(F.lit(1)).alias("triples"), F.count_distinct(subject).alias("subjects"), F.count_distinct(value).alias("objects"))
    return figures.withColumn("encoding", F.when((F.col("objects") <= MOST_VALUES) & (F.col("triples") >= 2 * F.col("objects")), F.lit("inverted")).otherwise(F.lit("sorted")))


def bitmaps(rows: DataFrame, ident: str, group: str) -> DataFrame:
    """(group, bucket, bits): bitmaps of whole-number ids by group, in buckets of fixed size, so a large group is many rows."""
    return rows.groupBy(F.col(group).alias("group"), F.bitmap_bucket_number(ident).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(ident)).alias("bits"))


def bitmap_counts(maps: DataFrame) -> DataFrame:
    return maps.groupBy("group").agg(F.sum(F.bitmap_count("bits")).alias("n"))


# -- queries -------------------------------------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dict_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    return encoded(parts.select("p_partkey", F.col("p_type").alias("type")), {"type": dictionary(parts, "p_type")})


def _dict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    books = {c: dictionary(customers, c) for c in ("segment", "name")}
    return decoded(encoded(customers, books), books).select("c_custkey", "segment", "name")


def _inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted(_table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey").select("value", F.array_join("keys", ",").alias("keys"))


def _quads(spark: SparkSession, sf_dir: str, graphs: list[str]) -> DataFrame:
    from tessera.results import quads_text
    from tessera.sources.rdf import quads_of_lines
    from tessera.store import QuadStore

    lines = quads_text(QuadStore.tables(spark, sf_dir), [f"http://ex.org/g/{g}" for g in graphs])
    return quads_of_lines(settled(lines).withColumn("n", F.lit(0)), True)


def _iri_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iri_dictionary(_quads(spark, sf_dir, ["nation", "region"])).select("id", F.col("value").alias("iri"))


def _encoded_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads of ids, decoded again and counted."""
    quads = _quads(spark, sf_dir, ["nation", "region"])
    iris, literals = iri_dictionary(quads), literal_dictionary(quads)
    back = decoded(encoded_quads(quads, iris, literals).withColumn("p", F.col("p_id")), {"p": iris})
    return back.groupBy("p").agg(F.count("s_id").alias("subjects"), F.count("o_id").alias("objects"), F.count_distinct("o_id").alias("values"))


def _encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    long = lines.select(F.col("l_orderkey").alias("s"), F.explode(F.create_map(F.lit("flag"), "l_returnflag", F.lit("price"), F.col("l_extendedprice").cast("string"))).alias("p", "o"))
    return encoding_choice(long, "p", "s", "o")


def _graph_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmap_counts(bitmaps(_table(spark, sf_dir, "documents"), "doc_id", "source"))


def _kway_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = [_table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return merged(runs)


def _load_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation and region tables as N-Quads, loaded into a store, and counted by predicate."""
    from tessera.lineage import shared_folder
    from tessera.results import quads_text
    from tessera.sources.loader import load_quads
    from tessera.store import QuadStore

    folder = shared_folder(spark)
    source = QuadStore.tables(spark, sf_dir)
    quads_text(source, ["http://ex.org/g/nation", "http://ex.org/g/region"]).write.text(f"{folder}/dump.nq")
    store = QuadStore.open(spark, load_quads(spark, [(f"{folder}/dump.nq", "http://ex.org/g/rest")], f"{folder}/store"))
    return store.sparql("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p")


_LOADED = """
SELECT * FROM (VALUES ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)),
 ('http://ex.org/v#n_nationkey', (SELECT count(*) FROM nation)), ('http://ex.org/v#n_name', (SELECT count(*) FROM nation)), ('http://ex.org/v#n_regionkey', (SELECT count(*) FROM nation)),
 ('http://ex.org/v#r_regionkey', (SELECT count(*) FROM region)), ('http://ex.org/v#r_name', (SELECT count(*) FROM region))) t(p, n)
"""

_X, _V, _TYPE = "'http://ex.org/", "'http://ex.org/v#", "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'"
_IRIS = f"""
WITH iris AS (
  SELECT {_X}nation/' || n_nationkey AS iri FROM nation UNION SELECT {_X}region/' || r_regionkey FROM region UNION SELECT {_X}region/' || n_regionkey FROM nation
  UNION SELECT unnest([{_TYPE}, {_V}Nation', {_V}Region', {_V}n_nationkey', {_V}n_name', {_V}n_regionkey', {_V}r_regionkey', {_V}r_name', {_X}g/nation', {_X}g/region'])
) SELECT row_number() OVER (ORDER BY iri) - 1 AS id, iri FROM iris
"""
_CODED = f"""
SELECT {_TYPE} AS p, count(*) AS subjects, count(*) AS objects, 2 AS "values" FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)
UNION ALL SELECT {_V}n_nationkey', count(*), count(*), count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT {_V}n_name', count(*), count(*), count(DISTINCT n_name) FROM nation
UNION ALL SELECT {_V}n_regionkey', count(*), count(*), count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT {_V}r_regionkey', count(*), count(*), count(DISTINCT r_regionkey) FROM region
UNION ALL SELECT {_V}r_name', count(*), count(*), count(DISTINCT r_name) FROM region
"""
_CHOICE = """
SELECT predicate, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects, if(count(DISTINCT o) <= 32767 AND count(*) >= 2 * count(DISTINCT o), 'inverted', 'sorted') AS encoding
FROM (SELECT 'flag' AS predicate, l_orderkey AS s, l_returnflag AS o FROM lineitem UNION ALL SELECT 'price', l_orderkey, l_extendedprice::VARCHAR FROM lineitem) GROUP BY 1
"""

#: name: (function, DuckDB)
QUERIES = {
    "iri_dictionary": (_iri_ids, _IRIS),
    "encoded_quads": (_encoded_quads, _CODED),
    "encoding_choice": (_encodings, _CHOICE),
    "dict_encode": (_dict_encode, "SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS type FROM part"),
    "dict_roundtrip": (_dict_roundtrip, "SELECT c_custkey, c_mktsegment AS segment, c_name AS name FROM customer"),
    "inverted_index": (_inverted_index, "SELECT n_regionkey AS value, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1"),
    "graph_bitmap_count": (_graph_bitmaps, 'SELECT source AS "group", count(DISTINCT doc_id) AS n FROM documents GROUP BY 1'),
    "kway_distinct": (_kway_distinct, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation"),
    "load_nquads_roundtrip": (_load_roundtrip, _LOADED),
}
