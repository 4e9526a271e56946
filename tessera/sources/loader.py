"""Loading quads into a store: vertical partitions as Parquet, with a catalog, in stages that can be taken up again.

A partition is a predicate with a kind of subject and a kind, datatype or language of object. It holds each triple once, with the sorted set of its
graphs. All partitions are bucketed alike by subject, so that the patterns of one subject join without a shuffle; within a bucket rows are sorted by subject and object, so
row-group statistics serve seeks by subject, and Bloom filters those by object. Numeric and date literals are held by value: forms of the same value are one
term. Values that no native column holds (see tessera.values) are held by their forms, in partitions of their own. Stages: 1 parsed quads, 2 partitions, 3 catalog; a stage that has its mark is not done again. At the end the parsed quads are removed.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import Catalog, Partition, TermMap
from tessera.lineage import discard
from tessera.sources.rdf import QUAD, by_line, read_files, read_lines
from tessera.terms import DECIMAL, LANG_STRING, NATIVE
from tessera.values import DATES, UNBOUNDED, native_columns, parsed, physical, wide


class LoadError(RuntimeError):
    """A load that can't go on; code is the exit code of the command line."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


UNKNOWN_FORMAT, BAD_MANIFEST, BAD_GRAPH, BAD_VALUE = 1, 7, 10, 12
IRI = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:\S*")


def read_manifest(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Lines of a file's path, a tab, and its graph's IRI."""
    out = []
    for r in spark.read.text(path).collect():
        line = r["value"].strip()
        if not line:
            continue
        parts = line.split("\t")
        if len(parts) != 2 or ":" not in parts[1]:
            raise LoadError(BAD_MANIFEST, f"not a path and a graph: {line!r}")
        out.append((parts[0], parts[1]))
    return out


def read_quads(spark: SparkSession, files: list[tuple[str, str]], strict: bool = True) -> DataFrame:
    """The quads of files; a file's graph takes what its syntax puts in none, and is the base of relative IRIs."""
    lines, whole = [], []
    for n, (path, graph) in enumerate(files):
        if not IRI.fullmatch(graph or ""):
            raise LoadError(BAD_GRAPH, f"a graph must be an IRI: {graph!r}")
        try:
            (lines if by_line(path) else whole).append((path, graph, n))
        except ValueError as e:
            raise LoadError(UNKNOWN_FORMAT, str(e)) from e
    parts = ([read_lines(spark, lines, strict)] if lines else []) + ([read_files(spark, whole, strict)] if whole else [])
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], QUAD)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_quads(spark: SparkSession, files: list[tuple[str, str]] | str, out: str, strict: bool = True, stage: int | None = None, codec: str = "zstd", buckets: int | None = None) -> str:
    """Loads files (or a manifest) into a new store at out, and returns out. With stage, only that stage is done. buckets: by default from the number of quads."""
    if isinstance(files, str):
        files = read_manifest(spark, files)
    quads, done = f"{out}/stage1", lambda part: _exists(spark, f"{out}/{part}/_SUCCESS")
    if stage in (None, 1) and not any(map(done, ("stage1", "partitions", "catalog"))):
        read_quads(spark, files, strict).write.mode("overwrite").option("compression", codec).parquet(quads)
    if stage in (None, 2) and not any(map(done, ("partitions", "catalog"))):
        write_partitions(spark.read.schema(QUAD).parquet(quads), f"{out}/partitions", strict, codec, buckets)
    if stage in (None, 3) and not done("catalog"):
        write_catalog(spark, out)
    if stage in (None, 3):
        discard(spark, quads)
    return out


#: So many quads at most go to a bucket, on average: a task sorts one bucket's quads, so this bounds its memory. Small loads get smaller buckets, one for each of the session's
#: shuffle partitions, but none of under LEAST_QUADS.
BUCKET_QUADS, LEAST_QUADS, MOST_BUCKETS = 250_000, 20_000, 10_000


def bucket_count(quads: int, parts: int) -> int:
    needed = lambda size: -(-quads // size)
    return max(1, min(MOST_BUCKETS, max(needed(BUCKET_QUADS), min(parts, needed(LEAST_QUADS)))))


def write_partitions(quads: DataFrame, path: str, strict: bool, codec: str, buckets: int | None = None) -> None:
    """One shuffle takes the quads to their buckets; there the sets of graphs are made, and the rows go to their partitions' folders."""
    spark = quads.sparkSession
    n = buckets or bucket_count(quads.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bad = (F.col("g").isNull()) | ~F.col("g").rlike(f"^{IRI.pattern}$")
    if strict:
        quads = quads.withColumn("g", F.when(~bad, F.col("g")).otherwise(F.raise_error(F.concat(F.lit("a graph must be an IRI: "), F.coalesce("g", F.lit("null")))).cast("string")))
    else:
        quads = quads.where(~bad)
    natives = {dt: physical(dt) for dt in NATIVE if physical(dt) != "string"}
    value, native, is_wide_ = F.col("o_lex"), F.lit(None).cast("string"), F.lit(False)
    for dt in natives:
        native = F.when(F.col("o_dt") == dt, parsed(value, dt).cast("string")).otherwise(native)
        if dt in (*DATES, *UNBOUNDED, DECIMAL):
            is_wide_ = F.when(F.col("o_dt") == dt, wide(value, dt)).otherwise(is_wide_)
    typed = F.coalesce(F.col("o_dt").isin(*natives), F.lit(False))
    quads = quads.withColumn("o_wide", typed & F.coalesce(is_wide_, F.lit(False)))
    checked = F.when(F.col("o_wide"), F.trim(value)).when(typed, native).otherwise(value)
    if strict:
        checked = F.when(typed & ~F.col("o_wide") & native.isNull(), F.raise_error(F.concat(F.lit("not a value of "), F.col("o_dt"), F.lit(": "), value)).cast("string")).otherwise(checked)
    # a value that is none is an error, or its row goes; the count of buckets holds whatever Spark makes of the sizes
    quads = quads.where("o_lex is not null").repartition(n, "s").withColumn("o", checked)
    if not strict:
        quads = quads.where("o is not null")
    key = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang", "o_wide"]
    triples = quads.groupBy(*key).agg(F.sort_array(F.collect_set("g")).alias("g"))
    part = F.concat(F.lit("x"), F.substring(F.md5(F.concat_ws("\x1f", "p", "s_kind", "o_kind", F.coalesce("o_dt", F.lit("")), F.coalesce("o_lang", F.lit("")), F.when(F.col("o_wide"), F.lit("wide")).otherwise(F.lit(""))).cast("binary")), 1, 16))
    # an object column for each type, so that values keep their own
    by_value = typed & ~F.col("o_wide")
    columns = [F.when((F.col("o_dt") == dt) & ~F.col("o_wide"), F.col("o").try_cast(kind)).alias(native_columns()[dt]) for dt, kind in natives.items()]
    rows = triples.select("s", "s_kind", "p", F.when(~by_value, F.col("o")).alias("o_text"), *columns, "o_kind", "o_dt", "o_lang", "o_wide", "g", part.alias("part"))
    name = f"tessera_{uuid.uuid4().hex}"
    writer = rows.write.mode("overwrite").format("parquet").option("path", path).option("compression", codec)
    writer = writer.option("parquet.bloom.filter.enabled#o_text", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    # the files outlive the name
    writer.partitionBy("part").bucketBy(n, "s").sortBy("s", "o_text").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")


def _columns() -> str:
    natives = ", ".join(f"{c} {physical(dt)}" for dt, c in native_columns().items())
    return f"s string, s_kind string, p string, o_text string, {natives}, o_kind string, o_dt string, o_lang string, o_wide boolean, g array<string>, part string"


def write_catalog(spark: SparkSession, out: str) -> None:
    """The partitions with their counts: read from the written rows, one line for each."""
    rows = spark.read.schema(_columns()).parquet(f"{out}/partitions")
    value = F.coalesce("o_text", *[F.col(c).cast("string") for c in native_columns().values()])
    found = rows.groupBy("part", "p", "s_kind", "o_kind", "o_dt", "o_lang", "o_wide").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct(value).alias("objects"))
    listed = [r.asDict() for r in found.where("part is not null").orderBy("p", "part").collect()]
    files = [p.rsplit("/", 1)[-1] for p in rows.inputFiles()]
    buckets = 1 + max((int(m[1]) for f in files if (m := re.search(r"_(\d{5})\.", f))), default=0)
    _write_text(spark, f"{out}/catalog", json.dumps({"version": 2, "id": uuid.uuid4().hex, "buckets": buckets, "partitions": listed}))


def bucketed_table(spark: SparkSession, out: str, ident: str, buckets: int) -> str:
    """The name, in the session's catalog, under which the partitions' files are known with their buckets."""
    name = f"tessera_store_{ident}"
    if not spark.catalog.tableExists(name):
        place = f"{out}/partitions".replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_columns()}) USING parquet OPTIONS (path '{place}') PARTITIONED BY (part) CLUSTERED BY (s) SORTED BY (s, o_text) INTO {buckets} BUCKETS")
        spark.catalog.recoverPartitions(name)
    return name


def read_catalog(spark: SparkSession, out: str) -> Catalog:
    known = json.loads("".join(r["value"] for r in spark.read.text(f"{out}/catalog").collect()))
    natives, catalog = native_columns(), Catalog()
    kinds = {"iri": "iri", "bnode": "bnode", "literal": "lit"}
    table = bucketed_table(spark, out, known["id"], known["buckets"])
    catalog.whole = lambda: spark.table(table)
    for x in known["partitions"]:
        name = x["part"]
        catalog.frames[name] = lambda name=name: spark.table(table).where(F.col("part") == name)
        dt = x["o_dt"]
        column = natives[dt] if dt in natives and not x["o_wide"] else "o_text"
        objects = TermMap(kinds[x["o_kind"]], column, dt=dt, lang=x["o_lang"] if dt == LANG_STRING else None, wide=x["o_wide"])
        catalog.partitions.append(Partition(x["p"], name, TermMap(kinds[x["s_kind"]], "s"), objects, graphs="g", rows=x["rows"], subjects=x["subjects"], objects=x["objects"]))
    return catalog


def exit_code(error: Exception) -> int | None:
    """The code of an error, also of one that a task met."""
    if isinstance(error, LoadError):
        return error.code
    text = str(error)
    return BAD_GRAPH if "a graph must be an IRI" in text else BAD_VALUE if "not a value of" in text else None


def main(args: list[str]) -> int:
    """Command line: manifest, folder, and perhaps a stage and a codec. Returns the exit code."""
    spark = SparkSession.builder.getOrCreate()
    try:
        load_quads(spark, args[0], args[1], stage=int(args[2]) if len(args) > 2 and int(args[2]) else None, codec=args[3].lstrip(".") if len(args) > 3 else "zstd")
    except Exception as e:
        if (code := exit_code(e)) is None:
            raise
        print(str(e).split("\n")[0])
        return code
    return 0


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
