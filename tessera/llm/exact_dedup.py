"""Exact deduplication by an extendible-hash index on shared files; DataFrame operations only.

Texts are normalised by deleting white space and hashed to 64-bit keys. The directory has a slot for each value of the keys' first bits. It starts as one
bucket of depth 0; a bucket that holds more than `capacity` distinct keys is split in two on the next bit, again and again, so a bucket is a range of
keys. Keys are random, so they need about log2(keys / capacity) bits; `spare` more leave room for chance. The capacity grows with the input where there would
else be over 2**most_bits slots, which bounds the directory, the only thing that is broadcast besides the hot entries. A hot text is one key and overfills no bucket.

Copies are first counted within groups of map tasks, so that a text that fills a third of all rows gives a few rows. Then each entry goes to the task that owns its bucket.
There entries of one key form a chain, and are one only if their bytes are equal. The index on shared files has the chains by bucket and key. Every row then looks
up its bucket, key and digest; rows of hot entries (each with more rows than a partition should have, so no more of them than partitions) meet a broadcast copy of those.

Results for odd rows: a null text counts as empty (length 0), and all empty texts are one group; a null doc_id comes after all others when the row
to keep is chosen, and is kept only where its group has no other; rows that repeat doc_id and text are one row and stand or fall together; rows of one doc_id
with several texts are judged by their texts; a very long text is one row like any other; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, Scratch, partitions, text_or_empty

TOP = 1 << 64
LAST = (1 << 63) - 1


def _top() -> Column:
    return F.lit(str(TOP)).cast("decimal(20,0)")


def _slot(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def directory(slots: DataFrame, bits: int, capacity: int) -> DataFrame:
    """(slot, depth, bucket) of each row of (slot, n), n being the keys of one of 2**bits slots; a bucket goes by its first slot."""
    if not bits:
        return slots.select("slot", F.lit(0).alias("depth"), F.col("slot").alias("bucket"))
    # the bucket of a slot at each depth that may split
    at = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(slot, {bits} - depth)"))
    full = at.groupBy("depth", "prefix").agg(F.sum("n").alias("keys")).where(F.col("keys") > capacity).drop("keys")
    split = at.join(full, ["depth", "prefix"], "left_semi").groupBy("slot").agg((F.max("depth") + 1).alias("depth"))
    depths = slots.select("slot").join(split, "slot", "left").select("slot", F.coalesce("depth", F.lit(0)).alias("depth"))
    return depths.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)"))


def exact_groups(docs: DataFrame, capacity: int = 1024, spare: int = 3, most_bits: int = 17, key_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row. Of equal texts the longest original stays, then the smallest doc_id. Fewer key_bits make chains longer."""
    scratch, width = Scratch(docs.sparkSession), partitions(docs.sparkSession)
    norm = F.regexp_replace(text_or_empty(text_col), SPACES, "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text_or_empty(text_col)).alias("length"), norm.alias("norm"))
    rows = rows.withColumn("key", F.shiftleft(F.xxhash64("norm"), 64 - key_bits))
    looked_up = scratch.write(rows.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "keys")

    counts = scratch.write(looked_up.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "counts")
    total, n = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    bits = min(most_bits, max(0, math.ceil(math.log2(max(n, 1) / capacity)) + spare))
    capacity = max(capacity, n >> max(0, most_bits - spare))
    slots = counts.groupBy(_slot(F.col("key"), bits).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    table = F.broadcast(scratch.write(directory(slots, bits, capacity).select("slot", "bucket"), "directory"))  # at most 2**most_bits rows

    # one number orders rows by length and then by falling doc_id; a null doc_id comes last
    age = F.coalesce(F.lit(LAST) - F.col("doc_id").cast("decimal(20,0)") + 1, F.lit(0)).cast("decimal(20,0)")
    order = (F.col("length").cast("decimal(10,0)") * _top() + age).cast("decimal(38,0)")
    counted = rows.select("key", "norm", order.alias("place"), F.pmod(F.spark_partition_id(), F.lit(16)).alias("salt"))
    counted = counted.groupBy("key", "norm", "salt").agg(F.count(F.lit(1)).alias("rows"), F.max("place").alias("place"))
    # to the owners, who compare bytes within a chain
    owned = counted.withColumn("slot", _slot(F.col("key"), bits)).join(table, "slot").repartition(width, "bucket")
    chains = owned.groupBy("bucket", "key", "norm").agg(F.sum("rows").alias("group_size"), F.max("place").alias("place"))
    rest = F.col("place") % _top()
    entries = chains.select("bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "group_size", F.when(rest > 0, (F.lit(LAST) - rest + 1).cast("long")).alias("keep_id"))
    index = scratch.write(entries.sortWithinPartitions("bucket", "key"), "index")

    hot = F.col("group_size") * width > total  # of at most `width` entries
    routed = looked_up.withColumn("slot", _slot(F.col("key"), bits)).join(table, "slot").drop("slot")
    at_hand = routed.join(F.broadcast(index.where(hot)), ["bucket", "key", "text_sha256"], "left")
    cold = at_hand.where("group_size IS NULL").select("doc_id", "bucket", "key", "text_sha256").join(index.where(~hot), ["bucket", "key", "text_sha256"])
    found = at_hand.where("group_size IS NOT NULL").select(*cold.columns).unionByName(cold)
    scratch.drop(counts)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
