"""Mixing sources to target weights; DataFrame operations only.

Every source gets a share of the budget by its weight, never more than `most` times its own size; what is over goes to the
others by weight. Within a source, rows are put in a random order by a hash of doc_id: the hash is cut into ranges, each range is
sorted, and a row's place in the running sum of sizes is the sum of the ranges before plus that of the rows before in its range. Whole
epochs are taken as often as the budget holds them, and the last is cut where the budget ends, inside a document if need be.

Results for odd rows: a null source is a source, the last one; a null text has size 0 and gives 0; a null doc_id is hashed by its text; a very long text is one row like any other; rows
that repeat are counted each; rows of equal hash go by doc_id and size; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, partitions, text_or_empty, written


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds target to (source, source_size). Sources in the order of most * size / weight are full up to the first that is not."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    weighted = weighted.withColumn("full", F.col("source_size") * F.lit(float(most)))
    before = W.orderBy((F.col("full") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    parts = weighted.select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("full").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left_weight"),
    )
    parts = parts.withColumn("is_full", F.col("full") * F.col("left_weight") <= F.col("left") * F.col("weight"))
    # the level of those that are not full is set by the first of them
    first = F.max(F.when(~F.col("is_full"), F.struct("left_weight", "left"))).over(whole)
    return parts.withColumn("first", first).select("source", "source_size", F.when(F.col("is_full"), F.col("full")).otherwise(F.col("first.left") * F.col("weight") / F.col("first.left_weight")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, taken of each row."""
    spark = docs.sparkSession
    order = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), F.md5(text_or_empty(text_col).cast("binary")))), F.lit(":" + seed)).cast("binary"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"), order.alias("place")
    )
    rows = written(rows, "sizes")
    # ranges of the hash: enough for all tasks, and none of over about 100,000 rows, whatever a source holds
    ranges = max(4 * partitions(spark), math.ceil(rows.count() / 100_000))
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32)).cast("long"))

    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start"), F.sum("range_size").over(W.partitionBy("source")).alias("source_size"))
    goal = targets(sums.groupBy("source").agg(F.max("source_size").alias("source_size")), weights, share, most)
    goal = goal.select(F.col("source").alias("s"), "target", F.floor(F.col("target") + 0.5).cast("long").alias("budget"))
    known = sums.join(goal, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("range").alias("r"), "range_start", "source_size", "target", "budget")

    within = W.partitionBy("source", "range").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    epochs = F.coalesce(F.expr("try_divide(budget - pmod(budget, greatest(source_size, 1)), source_size)").cast("long"), F.lit(0))
    cut = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("range_start") - F.col("start")
    return placed.withColumn("epochs", epochs).select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), cut))).cast("long").alias("taken"))
