"""Memory bank of a conversation: turns, observations and session summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.operators import carry


def session_number(key: Column) -> Column:
    """Number of a ``session_<n>`` key, null for other keys."""
    return F.regexp_extract(key, "^session_([0-9]+)$", 1).try_cast("int")


def memory_bank(dialogue: DataFrame, observations: DataFrame, summaries: DataFrame) -> DataFrame:
    """One document per turn, observation and summary with the usual id schemes."""
    stamp = F.concat(F.lit("["), F.coalesce("date_time", F.lit("")), F.lit("] "))
    image = F.when(
        F.length(F.coalesce("blip_caption", F.lit(""))) > 0, F.concat(F.lit(" [Image: "), "blip_caption", F.lit("]"))
    ).otherwise("")
    turns = dialogue.select(
        "session",
        F.col("dia_id").alias("doc_id"),
        F.concat(stamp, "speaker", F.lit(": "), "text", image).alias("text"),
        F.lit("dialogue").alias("source"),
    )
    placed = carry.position(observations, ["session", "speaker"], ["seq"], F.floor(F.col("seq") / 4096), "n")
    text = F.coalesce("text", F.lit(""))
    seen = placed.filter(F.length(text) > 0).select(
        "session",
        F.concat(F.lit("O"), F.col("session").cast("string"), F.lit(":"), "speaker", F.lit(":"), F.col("n").cast("string")).alias("doc_id"),
        F.concat(stamp, F.lit("Observation about "), "speaker", F.lit(": "), "text").alias("text"),
        F.lit("observation").alias("source"),
    )
    summed = summaries.filter(F.length(F.coalesce("summary", F.lit(""))) > 0).select(
        "session",
        F.concat(F.lit("S"), F.col("session").cast("string")).alias("doc_id"),
        F.concat(stamp, F.lit("Session summary: "), "summary").alias("text"),
        F.lit("summary").alias("source"),
    )
    return turns.unionByName(seen).unionByName(summed)
