"""Removal of repeated passages by level-wise doubling.

A window is `width` consecutive words. Its words are removed if its word sequence also starts anywhere else. Windows are looked for at
a short length first, then at about twice that length, and so on up to width: each level hashes the windows of its length out of two of the last, and
what is not repeated at one length is not extended to the next. Below the full length not all windows need be looked at: each window of full
length is represented by the one within it that has the least hash, which is the same in all places where the full window
stands. So a window survives a level if its representative is found twice or more, no repeated window is ever lost, and the last level decides by the full windows.

Documents of equal words are one class, of which one text takes part; all its windows are repeated if it has copies. A document gives each hash once
with its number (up to two), so a word repeated a thousand times costs one row; counts are summed before they are shuffled. Hashes have 64 bits.

Results for odd rows: a null text has no words (n_words 0, the hash of the empty text); documents shorter than a window lose nothing; rows that repeat, with the same or
another doc_id, are copies; rows of one doc_id with several texts are documents of their own; a null doc_id is treated like any other; a very long text is one row like any other; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.lineage import discard
from tessera.llm.common import U64, Memo, Scratch, hash64, map_batches, mix, partitions


def levels(width: int, shortest: int = 8) -> list[int]:
    """The lengths of the levels: width, and halves of it, rounded up, down to about the shortest."""
    out = [width]
    while -(-out[0] // 2) >= shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def hashed(h: np.ndarray, length: int) -> np.ndarray:
    """The hashes of all windows of a length, each out of two of about half the length."""
    if length == 1:
        return h
    half = -(-length // 2)
    x = hashed(h, half)
    n = len(h) - length + 1
    return mix(x[:n], x[length - half : length - half + n])


def representatives(x: np.ndarray, length: int, width: int) -> np.ndarray:
    """For each full window the place of the window of that length in it with the least hash."""
    span = width - length + 1
    if span == 1:
        return np.arange(len(x))
    return np.lib.stride_tricks.sliding_window_view(x, span).argmin(1) + np.arange(len(x) - span + 1)


class Windows:
    """The full windows of a text that are still candidates."""

    def __init__(self, words: list[bytes], width: int, code: Memo, alive: bytes | None = None):
        self.h, self.width = np.fromiter(map(code.__getitem__, words), U64, len(words)), width
        n = max(0, len(words) - width + 1)
        self.alive = np.ones(n, bool) if alive is None else np.unpackbits(np.frombuffer(alive, np.uint8), count=n).astype(bool)

    def keep(self, length: int, found: np.ndarray) -> None:
        """Keeps the candidates whose representative is among what was found repeated."""
        x = hashed(self.h, length)
        self.alive &= np.isin(x[representatives(x, length, self.width)], found)

    def hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the candidates' representatives: those in one place here, and those in several."""
        if not self.alive.any():
            none = np.empty(0, np.int64)
            return none, none
        x = hashed(self.h, length)
        value, count = np.unique(x[np.unique(representatives(x, length, self.width)[self.alive])], return_counts=True)
        value = value.view(np.int64)
        return value[count == 1], value[count > 1]

    def packed(self) -> bytes:
        return np.packbits(self.alive).tobytes()


def cut(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _lists(x: list) -> pa.Array:
    return pa.array(x, pa.list_(pa.int64()))


def repeated(owners: DataFrame, back: Column) -> DataFrame:
    """(id, found): of each class's hashes (once, twice) those that are repeated; for a class with copies, those that others have too."""
    rows = owners.select("id", "copies", F.explode("once").alias("hash"), F.least("copies", F.lit(2)).alias("times")).unionByName(
        owners.select("id", "copies", F.explode("twice").alias("hash"), F.lit(2).cast("long").alias("times"))
    )
    total = rows.groupBy("hash").agg(F.sum("times").alias("all"), F.count(F.lit(1)).alias("classes")).where(F.col("all") > 1)
    hit = rows.where(back).join(total, "hash").where((F.col("copies") == 1) | (F.col("classes") > 1))
    return hit.groupBy("id").agg(F.collect_list("hash").alias("found"))


def bucketed(df: DataFrame, scratch: Scratch) -> tuple[str, str]:
    """The name and folder of a table on shared files, bucketed by id: joins on id then need not shuffle it again. The caller drops it from the catalog."""
    name, path = f"tessera_{uuid.uuid4().hex}", scratch.path("bucketed")
    df.write.bucketBy(partitions(scratch.spark), "id").option("path", path).saveAsTable(name)
    return name, path


def without_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    scratch, lengths = Scratch(docs.sparkSession), levels(width)
    # a row's id is a hash of its doc_id and text; classes go by `whole`, the digest of their words, and by the id of one of their rows
    ident = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), ident, F.col(text_col).cast("string").alias("text"))

    def first():
        code = Memo(hash64)

        def step(c: dict[str, list]) -> dict[str, object]:
            words = [cut(t) for t in c["text"]]
            pairs = [Windows(w, width, code).hashes(lengths[0]) for w in words]
            whole = [sha256(b" ".join(w)).digest() for w in words]
            return {"doc_id": c["doc_id"], "id": c["id"], "n": [len(w) for w in words], "whole": pa.array(whole, pa.binary()), "once": _lists([p[0] for p in pairs]), "twice": _lists([p[1] for p in pairs])}

        return step

    seen = scratch.write(map_batches(rows, first, "doc_id long, id long, n long, whole binary, once array<long>, twice array<long>"), "seen")
    long_ = seen.where(F.col("n") >= width)
    classes = scratch.write(long_.groupBy("whole").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    owners = long_.select("whole", "id", "once", "twice").join(classes, ["whole", "id"]).dropDuplicates(["whole"])
    # a class with copies and nothing shared with others can drop out; its own windows are known to be repeated
    hit = repeated(owners, F.lit(True)).join(classes, "id").select("id", "copies", "whole", "found")

    def second():
        code = Memo(hash64)

        def step(c: dict[str, list]) -> dict[str, object]:
            out = {k: [] for k in ("id", "whole", "copies", "text", "alive", "once", "twice")}
            for id_, copies, whole, found, text in zip(c["id"], c["copies"], c["whole"], c["found"], c["text"]):
                words = cut(text)
                if sha256(b" ".join(words)).digest() != whole:  # another text with the same id
                    continue
                w = Windows(words, width, code)
                w.keep(lengths[0], np.asarray(found, np.int64).view(U64))
                if w.alive.any():
                    once, twice = w.hashes(lengths[min(1, len(lengths) - 1)])
                    for k, v in zip(out, (id_, whole, copies, text, w.packed(), once, twice)):
                        out[k].append(v)
            return {"id": pa.array(out["id"], pa.int64()), "whole": pa.array(out["whole"], pa.binary()), "copies": pa.array(out["copies"], pa.int64()), "text": pa.array(out["text"], pa.string()), "alive": pa.array(out["alive"], pa.binary()), "once": _lists(out["once"]), "twice": _lists(out["twice"])}

        return step

    # rows that repeat doc_id and text meet the same class: one of them takes part
    texts = rows.select("id", "text").join(hit, "id").dropDuplicates(["id", "whole", "text"]).select("id", "copies", "whole", "found", "text")
    table, stored = bucketed(map_batches(texts, second, "id long, whole binary, copies long, text string, alive binary, once array<long>, twice array<long>"), scratch)
    alive = scratch.spark.table(table)

    def joined(bits: DataFrame, found: DataFrame) -> DataFrame:
        """The texts with what is known of them; two classes that share an id are told apart by `whole`."""
        own = bits.select("id", F.col("whole").alias("whole_"), "alive")
        return alive.select("id", "whole", "copies", "text").join(own, "id").where("whole = whole_").join(found, "id").select("id", "whole", "copies", "text", "alive", "found")

    def later(before: int, now: int):
        def make():
            code = Memo(hash64)

            def step(c: dict[str, list]) -> dict[str, object]:
                kept, pairs = [], []
                for text, bits, found in zip(c["text"], c["alive"], c["found"]):
                    w = Windows(cut(text), width, code, bits)
                    w.keep(before, np.asarray(found, np.int64).view(U64))
                    kept.append(w.packed())
                    pairs.append(w.hashes(now))
                return {"id": c["id"], "whole": pa.array(c["whole"], pa.binary()), "copies": c["copies"], "alive": pa.array(kept, pa.binary()), "once": _lists([p[0] for p in pairs]), "twice": _lists([p[1] for p in pairs])}

            return step

        return make

    owners = alive.select("id", "copies", "once", "twice")
    bits = alive.select("id", "whole", "alive")
    for before, now in zip(lengths[1:], lengths[2:]):
        work = joined(bits, repeated(owners, F.lit(True)))
        owners = scratch.write(map_batches(work, later(before, now), "id long, whole binary, copies long, alive binary, once array<long>, twice array<long>"), f"level{now}")
        bits = owners.select("id", "whole", "alive")
    found = repeated(owners, F.col("copies") == 1)

    def last():
        code = Memo(hash64)

        def step(c: dict[str, list]) -> dict[str, object]:
            removed, digest = [], []
            for text, bits_, got in zip(c["text"], c["alive"], c["found"]):
                words = cut(text)
                w = Windows(words, width, code, bits_)
                w.keep(width, np.asarray(got, np.int64).view(U64))
                edge = np.zeros(len(words) + 1, np.int64)
                edge[: len(w.alive)] += w.alive
                edge[width : width + len(w.alive)] -= w.alive
                out = np.cumsum(edge[:-1]) > 0
                removed.append(int(out.sum()))
                digest.append(sha256(b" ".join(words[i] for i in np.flatnonzero(~out))).hexdigest())
            return {"whole": pa.array(c["whole"], pa.binary()), "removed": pa.array(removed, pa.int64()), "digest": pa.array(digest, pa.string())}

        return step

    changed = scratch.write(map_batches(joined(bits, found).where("copies = 1"), last, "whole binary, removed long, digest string"), "changed")
    scratch.spark.sql(f"DROP TABLE {table}")
    scratch.drop(*([owners] if len(lengths) > 2 else []))
    discard(scratch.spark, stored)

    short = seen.where(F.col("n") < width).select("doc_id", "n", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("whole")).alias("kept_sha256"))
    rest = long_.select("doc_id", "n", "whole").join(classes.select("whole", "copies"), "whole").join(changed, "whole", "left")
    copied = F.col("copies") > 1
    rest = rest.select(
        "doc_id", "n", F.when(copied, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(sha256(b"").hexdigest())).otherwise(F.coalesce("digest", F.lower(F.hex("whole")))).alias("kept_sha256"),
    )
    return rest.unionByName(short).withColumnRenamed("n", "n_words")
