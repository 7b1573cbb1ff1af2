"""Count-based windows over ordered clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.operators import carry
from cliptide.operators.carry import Running

#: Fixed value: a scene summary reads at most this many text fragments.
SCENE_FRAGMENTS = 20


def batches(df: DataFrame, keys: list[str], order: list[str], chunk: Column, size: int, name: str = "batch") -> DataFrame:
    """Tumbling batches of ``size`` consecutive rows per key, numbered from zero."""
    placed = carry.position(df, keys, order, carry.chunk_if_hot(df, keys, chunk), "__pos")
    return placed.withColumn(name, F.floor((F.col("__pos") - 1) / size)).drop("__pos")


def scene_windows(
    clips: DataFrame, keys: list[str], clip: str, text: str, chunk: Column, size: int = 6
) -> DataFrame:
    """One scene per ``size`` clips, the remainder included; scenes without text emit nothing."""
    batched = batches(clips, keys, [clip], chunk, size, "scene")
    piece = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0, F.struct(clip, F.col(text).alias("text")))
    scenes = batched.groupBy(*keys, "scene").agg(
        F.max(clip).alias("last_clip"),
        F.count("*").alias("clips"),
        F.sort_array(F.collect_list(piece)).alias("__pieces"),
        F.sort_array(F.collect_list(F.col(clip))).alias("members"),
    )
    fragments = F.transform(F.slice("__pieces", 1, SCENE_FRAGMENTS), lambda p: p["text"])
    return scenes.filter(F.size("__pieces") > 0).select(
        *keys, "scene", "last_clip", "clips", "members", fragments.alias("fragments")
    )


def scene_edges(scenes: DataFrame, keys: list[str]) -> DataFrame:
    """Membership edges of weight 0.6 from each scene to its clips."""
    return scenes.select(
        *keys, "scene", F.explode("members").alias("member"), F.lit(0.6).alias("weight")
    )


def rolling_context(
    clips: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column, size: int = 3
) -> DataFrame:
    """Values of the ``size`` clips before each clip, oldest first.

    Every row offers itself to the next ``size`` positions; an equi-join key per position keeps
    hot keys spread.
    """
    placed = carry.position(clips, keys, order, carry.chunk_if_hot(clips, keys, chunk), "pos")
    offers = placed.select(
        *keys,
        F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + size)).alias("pos"),
        F.struct(F.col("pos").alias("at"), F.col(value).alias("value")).alias("offer"),
    )
    context = offers.groupBy(*keys, "pos").agg(F.sort_array(F.collect_list("offer")).alias("offers"))
    joined = placed.join(context, [*keys, "pos"], "left")
    values = F.transform(F.coalesce("offers", F.array().cast(offers_type(placed, value))), lambda o: o["value"])
    return joined.withColumn("context", values).drop("offers", "pos")


def offers_type(df: DataFrame, value: str) -> str:
    return f"array<struct<at:bigint,value:{dict(df.dtypes)[value]}>>"


def previous_known(
    clips: DataFrame, keys: list[str], order: list[str], value: Column, chunk: Column, name: str
) -> DataFrame:
    """Last known value before each row; rows without a value do not reset it."""
    chunk = carry.chunk_if_hot(clips, keys, chunk)
    return carry.running(clips, keys, order, chunk, {name: Running("last", value, inclusive=False)})


def stacked_frames(
    frames: DataFrame, keys: list[str], pos: str, value: str, m: int, n: int, length: str
) -> DataFrame:
    """Stack ``m`` frames every ``n``, repeating the edge frames outside the signal.

    ``pos`` counts frames from zero and ``length`` holds the frames per key.
    """
    half = (m - 1) // 2
    starts = frames.filter(F.col(pos) % n == 0).select(*keys, F.col(pos).alias("centre"), F.col(length))
    wanted = starts.select(
        *keys,
        "centre",
        F.posexplode(F.sequence(F.col("centre") - half, F.col("centre") - half + m - 1)).alias("slot", "raw"),
        length,
    ).withColumn(pos, F.least(F.greatest(F.col("raw"), F.lit(0)), F.col(length) - 1))
    joined = wanted.join(frames.select(*keys, pos, value), [*keys, pos])
    return joined.groupBy(*keys, "centre").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("slot", value))), lambda s: s[value]).alias("stack")
    )
