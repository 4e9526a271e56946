"""The queries of the operators, with production parameters, over whole tables; each result follows its contract."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import documents

#: The key of the pseudonyms. Where none is given each session has a random one, so nobody can invert its result and sessions are not linked.
KEY = os.environ.get("TESSERA_PSEUDONYM_KEY") or secrets.token_hex(32)


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file; TESSERA_TOKENIZERS names another folder."""
    folder = os.environ.get("TESSERA_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sentencepiece_codec import encode_checked

    return encode_checked(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_dedup import near_groups

    return near_groups(documents(spark, sf_dir), width=2)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import exact_groups

    return exact_groups(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shards

    return shards(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mixed

    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pseudonyms import pseudonymise

    return pseudonymise(documents(spark, sf_dir), KEY)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import without_repeats

    return without_repeats(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import quality

    return quality(documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language import language

    return language(documents(spark, sf_dir))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f) and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from tessera.llm.oracles import SQL

    return dict(SQL)
