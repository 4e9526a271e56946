"""The store's interface: open a store of Parquet partitions or a folder of tables, scan statements, run SPARQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import Catalog, Partition
from tessera.plans.compiler import Compiler, Graphs
from tessera.sparql.parser import parse
from tessera.terms import Iri, Var
from tessera.values import VT, iri_text, native_columns, output


class ReadOnlyError(RuntimeError):
    """A store can't be changed once it is loaded."""


class QuadStore:
    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog = spark, catalog

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> QuadStore:
        """A store that load_quads() wrote."""
        from tessera.sources.loader import read_catalog

        return cls(spark, read_catalog(spark, path))

    @classmethod
    def tables(cls, spark: SparkSession, folder: str) -> QuadStore:
        """The test tables as virtual quads."""
        from tessera.sources.tables import driver_tables, table_catalog

        return cls(spark, table_catalog(spark, folder, driver_tables()))

    # -- queries -------------------------------------------------------------------------------------------------------

    def sparql(self, text: str, bindings: dict | None = None, base: str = "", include_inferred: bool = False) -> DataFrame:
        """The result as a DataFrame, a column for each variable. Nothing is inferred, whatever include_inferred says."""
        return self.typed(text, bindings, base)[0]

    def typed(self, text: str, bindings: dict | None = None, base: str = "") -> tuple[DataFrame, dict[str, VT]]:
        return Compiler(self.spark, self.catalog, base, bindings).run(parse(text, base))

    # -- statements ----------------------------------------------------------------------------------------------------

    def statements(self, s=None, p=None, o=None, graphs: list[str | None] | None = None, ordered: bool = False) -> DataFrame:
        """s, p, o of the matching triples, each once. graphs: any of these; None among them, or no list, means all; unknown ones match nothing."""
        wanted = tuple(graphs or ())
        g = Graphs() if None in wanted or not wanted else Graphs(default=wanted)
        terms = [x if x is not None else Var(n) for x, n in ((s, "s"), (p, "p"), (o, "o"))]
        r = Compiler(self.spark, self.catalog).bgp([tuple(terms)], g)
        cols = [(output(r.e(n)) if isinstance(x, Var) else F.lit(_shown(x))).alias(n) for n, x in zip("spo", terms)]
        df = r.df.select(*cols)
        return df.orderBy("p", "s", "o") if ordered else df

    def partitions(self, predicate: str | None = None) -> list[Partition]:
        return self.catalog.of(predicate)

    def size(self, graphs: list[str] | None = None) -> int:
        """The number of triples, of some graphs or of all. Of all it is in a loaded store's catalog."""
        if not graphs and self.catalog.whole:
            return sum(p.rows for p in self.catalog.partitions)
        return self.statements(graphs=graphs).count() if self.catalog.partitions else 0

    def graphs(self) -> DataFrame:
        """The graphs' IRIs."""
        if self.catalog.whole:
            return self.catalog.whole().select(F.explode("g").alias("graph")).distinct()
        parts = [self.spark.createDataFrame([(g,) for g in dict.fromkeys(p.graph for p in self.catalog.partitions if p.graph)], "graph string")]
        for source, graphs in dict.fromkeys((p.source, p.graphs) for p in self.catalog.partitions if p.graphs):
            parts.append(self.catalog.frame(source).select(F.explode(F.expr(graphs)).alias("graph")))
        return reduce(DataFrame.unionAll, parts).distinct()

    def statistics(self) -> DataFrame:
        """predicate, triples, subjects, objects of each predicate."""
        if self.catalog.whole:
            value = F.struct("o_kind", F.coalesce("o_text", *[F.col(c).cast("string") for c in native_columns().values()]), "o_dt", "o_lang")
            return self.catalog.whole().groupBy(F.col("p").alias("predicate")).agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s_kind", "s").alias("subjects"), F.count_distinct(value).alias("objects"))
        compiler = Compiler(self.spark, self.catalog)
        parts = [self.spark.createDataFrame([], "predicate string, s string, o string")]
        for p in self.catalog.partitions:
            r = compiler.scan([((Var("s"), Iri(p.predicate), Var("o")), p)], Graphs())
            s = iri_text(r.e("s")) if r.vt["s"].kind == "iri" else F.concat(F.lit("_:"), F.col("s"))
            parts.append(r.df.select(F.lit(p.predicate).alias("predicate"), s.alias("s"), output(r.e("o")).cast("string").alias("o")))
        return reduce(DataFrame.unionAll, parts).groupBy("predicate").agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))

    def namespaces(self) -> dict[str, str]:
        return dict(self.catalog.namespaces)

    # -- changes -------------------------------------------------------------------------------------------------------

    def _read_only(self, *args, **kw):
        raise ReadOnlyError("the store is read-only: load another one")

    add = remove = clear = begin = commit = rollback = _read_only


def _shown(term) -> str:
    return term.value if isinstance(term, Iri) else getattr(term, "lex", None) or f"_:{term.label}"


