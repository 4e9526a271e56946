"""Quads from a stream of N-Triples or N-Quads files, each triple of a graph once within a horizon. An extension: the store itself is loaded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.rdf import quads_of_lines


def stream_quads(spark: SparkSession, folder: str, graph: str, horizon: str = "1 hour") -> DataFrame:
    """A streaming DataFrame of the quads in files that come into a folder. State is kept for the horizon, by time of arrival."""
    lines = spark.readStream.text(folder).select("value", F.lit(0).alias("n"), F.current_timestamp().alias("at"))
    quads = quads_of_lines(lines, strict=False, also=["at"]).withColumn("g", F.coalesce("g", F.lit(graph)))
    own = ["s", "s_kind", "p", "o_lex", "o_kind", "o_dt", "o_lang", "g"]
    return quads.withWatermark("at", horizon).dropDuplicatesWithinWatermark(own).select(*own)
