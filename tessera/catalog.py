"""The catalog: vertical partitions, each a predicate with one kind of subject and one kind, datatype or language of object.

A partition is declared over a frame (a Parquet table of the store, or any relational table) by column expressions, so its
columns have static types. Graphs are a set attribute of a triple: a constant, or an expression that gives an array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.values import literal


@dataclass(frozen=True)
class TermMap:
    """How rows give a term. kind: iri, bnode or lit. prefix: the IRI is prefix + expr. const: the same IRI in all rows. wide: literals that no native column can hold, by their
    lexical forms. mixed: expr gives a poly struct."""

    kind: str
    expr: str = ""
    prefix: str | None = None
    dt: str | None = None
    lang: str | None = None
    const: str | None = None
    wide: bool = False
    mixed: bool = False

    def column(self) -> Column:
        if self.wide:
            return literal(F.expr(self.expr), self.dt, self.lang)
        return F.lit(self.const) if self.const is not None else F.expr(self.expr)


@dataclass(frozen=True)
class Partition:
    predicate: str | None  # None: column p tells
    source: str
    subject: TermMap
    object: TermMap
    where: str | None = None
    graph: str | None = None  # all triples are in this graph
    graphs: str | None = None  # or: an expression for the array of graphs
    unique: bool = False  # a subject stands in one row of the source
    rows: int | None = None  # and its triples, subjects and objects, where they are known
    subjects: int | None = None
    objects: int | None = None

    def graph_column(self) -> Column:
        return F.array(F.lit(self.graph)) if self.graphs is None else F.expr(self.graphs)


@dataclass
class Catalog:
    partitions: list[Partition] = field(default_factory=list)
    frames: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    namespaces: dict[str, str] = field(default_factory=dict)
    whole: Callable[[], DataFrame] | None = None  # all partitions of a loaded store, with column part
    _held: dict[str, DataFrame] = field(default_factory=dict)
    _sizes: dict[str, float] = field(default_factory=dict)

    def frame(self, source: str) -> DataFrame:
        if source not in self._held:
            self._held[source] = self.frames[source]()
        return self._held[source]

    def size(self, source: str) -> float:
        """Bytes by Spark's own statistics: no job is run."""
        if source not in self._sizes:
            stats = self.frame(source)._jdf.queryExecution().optimizedPlan().stats()
            self._sizes[source] = float(str(stats.sizeInBytes()))
        return self._sizes[source]

    def of(self, predicate: str | None) -> list[Partition]:
        return [p for p in self.partitions if predicate is None or p.predicate == predicate]

    def predicates(self) -> list[str]:
        return list(dict.fromkeys(p.predicate for p in self.partitions))
