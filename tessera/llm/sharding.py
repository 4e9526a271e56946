"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents of equal text form a group, which stays in one shard unless it is larger than a shard should be (in any of the three measures). A group that has over
a parcel's share of a measure is packed for itself; there are a few thousand of these at most, whatever the input. Smaller groups are gathered by hash
into a fixed number of parcels. A group larger than a shard is cut by a hash of its rows into pieces of a parcel's share. Groups, parcels and pieces are
placed by falling size, each in the shard where the dot product of its measures with what the shard still lacks is highest. Law: `bytes`.
Slots are counted in stretches of about `stretch` rows, so no task numbers a whole shard or group.

Results for odd rows: a null text has no bytes and no tokens and is grouped with the empty one; rows that repeat are placed each, in one shard; a null doc_id is numbered like any other; a
very long text, larger than a shard, makes that shard larger; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Scratch, text_or_empty

MEASURES = ("size", "tokens", "rows")


def pack(items: np.ndarray, shards: int, weights: tuple[float, ...] = (1.0, 0.1, 0.1)) -> np.ndarray:
    """The shard of each item (a row of measures)."""
    total = np.maximum(items.sum(0), 1.0)
    v = items / (total / shards)  # in shards' capacities
    left = np.ones((shards, items.shape[1]))
    w, out = np.asarray(weights), np.zeros(len(items), np.int64)
    for i in np.argsort(-v.max(1), kind="stable"):
        out[i] = s = int(np.argmax(left @ (w * v[i])))
        left[s] -= v[i]
    return out


def shards(docs: DataFrame, n: int = 24, parcels_each: int = 256, stretch: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text, parcels = text_or_empty(text_col), n * parcels_each
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"), F.xxhash64(text).alias("hash")
    )
    rows = scratch.write(rows.withColumns({"rows": F.lit(1).cast("long"), "row": F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))}), "sizes")

    total = rows.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]).first()
    part = {m: max(1.0, 4 * total[m] / parcels) for m in MEASURES}  # the most that a parcel should have
    groups = rows.groupBy("hash").agg(*[F.sum(m).alias(m) for m in MEASURES])
    share = F.greatest(*[F.col(m) / F.lit(part[m]) for m in MEASURES])
    full = F.greatest(*[F.col(m) / F.lit(max(1.0, total[m] / n)) for m in MEASURES])
    # groups of over one part: at most 3 * parcels / 4 of them
    large = groups.select("hash", F.when(full > 1, F.ceil(share)).otherwise(1).alias("pieces"), share.alias("share")).where("share > 1").orderBy("hash").collect()
    first, known = parcels, []
    for r in large:
        known.append((r["hash"], first, r["pieces"]))
        first += r["pieces"]
    cut = F.broadcast(spark.createDataFrame(known, "hash long, first long, pieces long"))
    piece = F.when(F.col("first").isNull(), F.pmod("hash", F.lit(parcels))).otherwise(F.col("first") + F.pmod("row", "pieces"))
    rows = rows.join(cut, "hash", "left").select("doc_id", "size", "tokens", "rows", "text_crc32", "row", piece.cast("long").alias("parcel"))

    items = sorted(rows.groupBy("parcel").agg(*[F.sum(m).alias(m) for m in MEASURES]).collect())  # of a number that does not depend on the input
    placed = pack(np.array([[r[m] for m in MEASURES] for r in items], float).reshape(-1, len(MEASURES)), n)
    where = F.broadcast(spark.createDataFrame([(r["parcel"], s, -(-r["rows"] // stretch)) for r, s in zip(items, placed.tolist())], "parcel long, shard int, stretches long"))
    rows = rows.join(where, "parcel").withColumn("part", F.pmod(F.xxhash64("row"), "stretches"))
    before = W.partitionBy("shard").orderBy("parcel", "part").rowsBetween(W.unboundedPreceding, -1)  # a row for each stretch
    starts = rows.groupBy("shard", "parcel", "part").agg(F.count(F.lit(1)).alias("c")).select("parcel", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("number", F.row_number().over(W.partitionBy("parcel", "part").orderBy("doc_id", "size", "text_crc32")))
    slot = (F.col("start") + F.col("number") - 1).cast("long").alias("slot")
    return numbered.join(starts, ["parcel", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
