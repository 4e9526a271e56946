"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing to target weights, SentencePiece coding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of documents.

Odd rows: texts that are null, empty or without a letter go in the first stage; a row that repeats another goes in the second, rows of one doc_id with several
texts are documents of their own; very long texts pass whole;
the mixing stage gives a row for each time a document is taken, the last perhaps with only its first words; extra columns
stay until the last stage, which returns doc_id, ids, n_pieces and round_trip. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, WORD, documents, text_or_empty, written
from tessera.llm.exact_dedup import exact_groups
from tessera.llm.language import accepted, learn
from tessera.llm.mixing import mixed
from tessera.llm.near_dedup import near_kept
from tessera.llm.queries import tokenizer
from tessera.llm.sentencepiece_codec import encode_checked


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told, or is ambiguous, go."""
    return accepted(docs, learn(docs))


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column has them."""
    out = []
    for name in names:
        while name.lower() in (c.lower() for c in docs.columns):
            name = "_" + name
        out.append(name)
    return out


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    ident, sha, own = _free(docs, "_id", "_sha", "_own")
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias(ident), F.col("text_sha256").alias(sha)).distinct()
    marked = docs.withColumn(own, F.sha2(F.regexp_replace(text_or_empty(), SPACES, ""), 256))
    joined = marked.join(kept, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(sha)), "left_semi")
    return joined.dropDuplicates(["doc_id", own]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id stays."""
    ident, mark = _free(docs, "_id", "_mark")
    kept = near_kept(docs).select(F.col("doc_id").alias(ident), F.col("mark").alias(mark))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.xxhash64(F.col("text").cast("string")) == F.col(mark)), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken; where the budget ends inside a document, its first words."""
    ident, size, taken, own, words = _free(docs, "_id", "_size", "_taken", "_own", "_words")
    plan = mixed(docs).where("taken > 0").groupBy(F.col("doc_id").alias(ident), F.col("size").alias(size)).agg(F.max("taken").alias(taken))
    sized = docs.withColumn(own, F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long"))
    times = sized.join(plan, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(size)))
    epochs = F.sequence(F.lit(1).cast("long"), F.ceil(F.col(taken) / F.col(size)))
    parts = times.withColumn(words, F.explode(F.transform(epochs, lambda i: F.least(F.col(size), F.col(taken) - (i - 1) * F.col(size)))))
    cut = F.col(words) < F.col(size)
    text = F.when(cut, F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col(words).cast("int")), " ")).otherwise(F.col("text"))
    out = parts.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and whether they decode to its text."""
    return encode_checked(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: SQL can't express the language classifier, the near-duplicate groups and the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
