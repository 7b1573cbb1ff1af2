"""Interval joins, merging and look-back joins as bucketed equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.operators import carry
from cliptide.operators.carry import Running


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], bounds: tuple[str, str], width: int
) -> DataFrame:
    """Pairs of intervals that share more than a boundary point, each pair once.

    Intervals are laid on a grid of ``width``; both sides join on key and grid cell, and a pair is
    kept in the cell where the later of the two starts. A hot key is spread over its cells.
    """
    start, end = bounds

    def gridded(df: DataFrame, side: str) -> DataFrame:
        renamed = df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys])
        s, e = F.col(f"{side}_{start}"), F.col(f"{side}_{end}")
        valid = renamed.filter(s.isNotNull() & e.isNotNull() & (e >= s))
        cells = F.sequence(F.floor(s / width), F.floor(e / width))
        return valid.withColumn("cell", F.explode(cells))

    pairs = gridded(left, "l").join(gridded(right, "r"), [*keys, "cell"])
    l_start, l_end = F.col(f"l_{start}"), F.col(f"l_{end}")
    r_start, r_end = F.col(f"r_{start}"), F.col(f"r_{end}")
    home = F.floor(F.greatest(l_start, r_start) / width)
    return pairs.filter((F.col("cell") == home) & (l_start < r_end) & (r_start < l_end)).drop("cell")


def overlap_length(bounds: tuple[str, str]) -> Column:
    """Shared length of a joined pair."""
    start, end = bounds
    return F.least(F.col(f"l_{end}"), F.col(f"r_{end}")) - F.greatest(F.col(f"l_{start}"), F.col(f"r_{start}"))


def overlapping_speakers(
    spans: DataFrame, speakers: DataFrame, keys: list[str], group: str, speaker: str, width: int, floor: float
) -> DataFrame:
    """Speakers overlapping each group for more than ``floor``, or half their own time if less."""
    pairs = overlap_join(spans, speakers, keys, ("start", "end"), width)
    shared = pairs.groupBy(*keys, F.col(f"l_{group}").alias(group), F.col(f"r_{speaker}").alias(speaker)).agg(
        F.sum(overlap_length(("start", "end"))).alias("shared")
    )
    own = speakers.groupBy(*keys, speaker).agg((F.sum(F.col("end") - F.col("start")) * 0.5).alias("half"))
    joined = shared.join(own, [*keys, speaker])
    return joined.filter(F.col("shared") > F.least(F.col("half"), F.lit(floor))).drop("half")


def look_back_join(
    queries: DataFrame, cues: DataFrame, keys: list[str], at: str, cue_at: str, window: int
) -> DataFrame:
    """Cues with ``at - window <= cue_at <= at``: each query visits the two grid cells it can reach."""
    q = queries.withColumn(
        "cell",
        F.explode(F.array(F.floor(F.col(at) / window), F.floor(F.col(at) / window) - 1)),
    )
    c = cues.withColumn("cell", F.floor(F.col(cue_at) / window))
    joined = q.join(c, [*keys, "cell"]).drop("cell")
    return joined.filter((F.col(cue_at) >= F.col(at) - window) & (F.col(cue_at) <= F.col(at)))


def next_at_or_after(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, chunk_width: int
) -> DataFrame:
    """Smallest ``right_at`` not before ``at``, null if none (a forward as-of join).

    Both sides are stacked and scanned backwards; no pair of rows is formed.
    """
    stacked = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__left")).distinct().unionByName(
        right.select(*keys, F.col(right_at).alias("__at"), F.lit(2).alias("__left")).distinct()
    )
    seen = carry.running(
        stacked,
        keys,
        ["__at", "__left"],
        carry.chunk_if_hot(stacked, keys, F.floor(F.col("__at") / chunk_width)),
        {"next": Running("last", F.when(F.col("__left") == 2, F.col("__at")))},
        descending=True,
    )
    answers = seen.filter(F.col("__left") == 1).select(*keys, F.col("__at").alias(at), "next")
    return left.join(answers, [*keys, at], "left")


def merge_intervals(
    df: DataFrame, keys: list[str], tie: str, chunk: Column, gap: int = 0, strict: bool = False
) -> DataFrame:
    """Merged intervals per key: touching (or at most ``gap`` apart) intervals become one."""
    chunk = carry.chunk_if_hot(df, keys, chunk)
    numbered = carry.islands(df, keys, "start", "end", tie, chunk, gap, strict)
    return numbered.groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("members")
    )


def interval_iou(left: DataFrame, right: DataFrame, keys: list[str], tie: str, width: int) -> DataFrame:
    """Intersection over union of two interval sets per key, both merged first."""
    chunk = F.floor(F.col("start") / width)
    a = merge_intervals(left, keys, tie, chunk).select(*keys, "start", "end")
    b = merge_intervals(right, keys, tie, chunk).select(*keys, "start", "end")
    shared = (
        overlap_join(a, b, keys, ("start", "end"), width)
        .groupBy(*keys)
        .agg(F.sum(overlap_length(("start", "end"))).alias("inter"))
    )
    size = lambda df, n: df.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(n))
    both = size(a, "la").join(size(b, "lb"), keys, "full").join(shared, keys, "left").na.fill(0)
    union = F.col("la") + F.col("lb") - F.col("inter")
    iou = F.when(union > 0, F.col("inter") / union).otherwise(F.lit(0.0))
    return both.select(*keys, "inter", union.alias("union"), iou.alias("iou"))


def merge_turns(
    df: DataFrame, keys: list[str], speaker: str, tie: str, chunk: Column, gap: int
) -> DataFrame:
    """Merge neighbouring turns of one speaker at most ``gap`` apart; a speaker change always splits."""
    chunk = carry.chunk_if_hot(df, keys, chunk)
    marked = carry.running(
        df, keys, ["start", tie], chunk, {"__was": Running("last", F.col(speaker), inclusive=False)}
    )
    change = marked.withColumn(
        "__change", F.when(F.col("__was").isNull() | (F.col("__was") != F.col(speaker)), 1).otherwise(0)
    ).drop("__was")
    runs = carry.running(carry.settled(change, chunk), keys, ["start", tie], chunk, {"run": Running("sum", F.col("__change"))})
    runs = carry.settled(runs.drop("__change"), chunk)
    numbered = carry.islands(runs, [*keys, "run"], "start", "end", tie, chunk, gap)
    return numbered.groupBy(*keys, "run", "island", speaker).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("turns")
    )


def dialogue_links(
    turns: DataFrame, keys: list[str], speaker: str, tie: str, chunk: Column, gap: int
) -> DataFrame:
    """Link each turn to the previous one when speakers differ and the pause is at most ``gap``."""
    before = F.struct(F.col(speaker).alias("speaker"), F.col("end").alias("end"))
    chunk = carry.chunk_if_hot(turns, keys, chunk)
    seen = carry.running(
        turns, keys, ["start", tie], chunk, {"before": Running("last", before, inclusive=False)}
    )
    linked = seen.filter(
        (F.col("before.speaker") != F.col(speaker)) & (F.col("start") - F.col("before.end") <= gap)
    )
    return linked.select(
        *keys,
        tie,
        F.least(F.col("before.speaker"), F.col(speaker)).alias("src"),
        F.greatest(F.col("before.speaker"), F.col(speaker)).alias("dst"),
        F.lit(0.5).alias("weight"),
    )
