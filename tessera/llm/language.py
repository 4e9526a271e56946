"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed letter n-grams (log ratios of smoothed counts on both
sides of the bit) gives a margin. Decoding takes the codeword with the least summed logistic loss. The score is the share of
exp(-loss) of the chosen language; a text whose two best losses are near each other is flagged as ambiguous.

Learning takes at most `sample` labelled rows of at most `longest` bytes each, shared out evenly among the languages (the `most_langs` most frequent) and drawn by a hash of
doc_id and text: a bound on what the driver gets, whatever the input.

Results for odd rows: a null text and a text without a letter (Unicode's category L) give `und`, score 0 and ambiguous; with no labelled row every text is `und`; of equal losses the
language that comes first by name is taken, and the text is ambiguous; a very long text is judged whole; rows with the same or a null
doc_id are judged one by one (a null doc_id is never held out nor learned from); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, release, small_batches

UNKNOWN = "und"
BITS = 15


def held_out(id_col: str = "doc_id"):
    """crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1 and -1: all splits of up to 6 languages, else random ones of 8 bits for each doubling."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 6:
        columns = [[1] + [1 if c >> i & 1 else -1 for i in range(k - 1)] for c in range(2 ** (k - 1) - 1)]
        return np.array(columns, np.int8).T
    width, rng = 8 * int(np.ceil(np.log2(k))) + 7, np.random.default_rng(seed)
    while True:
        code = rng.choice(np.array([-1, 1], np.int8), (k, width))
        if len(np.unique(code, axis=0)) == k and (np.abs(code.sum(0)) < k).all():
            return code


def grams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, spaces included."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    return (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # grams x bits
    scale: float  # of margins, so that losses are of order one

    def margins(self, text: str) -> np.ndarray:
        total, ids = np.zeros(self.weights.shape[1]), grams(text)
        for at in range(0, len(ids), 65536):
            total += self.weights.take(ids[at : at + 65536], axis=0).sum(0, dtype=np.float64)
        return self.scale * total / max(1, len(ids))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        loss = np.logaddexp(0, -self.code * self.margins(text)).sum(1)
        best, second = np.argsort(loss, kind="stable")[:2]
        share = np.exp(loss[best] - loss)
        return self.langs[best], float(1 / share.sum()), bool(loss[second] - loss[best] < 0.5)


def fit(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    counts = np.zeros((len(names), 1 << BITS))
    for t, lang in zip(texts, langs):
        counts[names.index(lang)] += np.bincount(grams(t), minlength=1 << BITS)
    code = codewords(len(names))
    weights = np.zeros((1 << BITS, code.shape[1]), np.float32)
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)  # each language counts alike
    floor = 1e-6
    for j in range(code.shape[1] if len(names) > 1 else 0):
        a, b = (share[code[:, j] == s].mean(0) + floor for s in (1, -1))
        weights[:, j] = np.log(a / b)
    return Model(names, code, weights, 8.0)


def learn(docs: DataFrame, sample: int = 2000, longest: int = 20_000, most_langs: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id") & (F.octet_length("text") <= longest))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    if not sizes:
        return fit([], [])
    each = max(1, sample // len(sizes))
    # by a hash below each language's threshold: a little more than its share, of which the least hashes are taken
    limits = {r["lang"]: min(1.0, (1.2 * each + 10) / r["count"]) for r in sizes}
    shared = F.broadcast(docs.sparkSession.createDataFrame(list(limits.items()), "lang string, share double"))
    place = F.xxhash64("id", "text")
    drawn = rows.join(shared, "lang").withColumn("place", place).where(F.pmod("place", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    drawn = drawn.dropDuplicates(["lang", "place"])  # repeated rows
    best = drawn.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("place", "text"))).where(F.col("rank") <= each)
    got = best.orderBy("lang", "rank").select("text", "lang").limit(sample).collect()
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits and 2**BITS x bits numbers: independent of the rows

    def make():
        predict = held.value.predict

        def step(c: dict[str, list]) -> dict[str, object]:
            lang, score, ambiguous = zip(*map(predict, c["text"]))
            return {"doc_id": c["doc_id"], "held_out": c["held_out"], "lang_pred": list(lang), "score": list(score), "ambiguous": list(ambiguous)}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", rows: int = 256) -> DataFrame:
    """The rows, all columns as they are, whose language is known: neither `und` nor ambiguous."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def known(text: str | None) -> bool:
        lang, _, ambiguous = held.value.predict(text)
        return lang != UNKNOWN and not ambiguous

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = pc.cast(part.column(part.schema.get_field_index(text_col)), pa.string())
                yield part.filter(pa.array(map(known, texts.to_pylist()), pa.bool_()))
            size = batch.nbytes
            batch = part = texts = None
            release(size)

    return small_batches(docs).mapInArrow(run, docs.schema)


def language(docs: DataFrame, sample: int = 2000) -> DataFrame:
    return identify(docs, learn(docs, sample))
