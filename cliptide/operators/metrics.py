"""Verification metrics over scored trials.

Trials are first summed per distinct score (map-side), so a score shared by a third of all rows
is one row; running sums over scores go band by band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.functions import vectors as V
from cliptide.operators import carry
from cliptide.operators.carry import Running


def roc_points(df: DataFrame, score: str, label: str, band: float, weight: Column | None = None) -> DataFrame:
    """Miss and false-accept rate at every distinct score (thresholds at tied scores coincide)."""
    w = weight if weight is not None else F.lit(1.0)
    counts = df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("targets"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("impostors"),
    )
    specs = {
        "below_targets": Running("sum", F.col("targets")),
        "below_impostors": Running("sum", F.col("impostors")),
    }
    summed = carry.running(counts, [], ["score"], F.floor(F.col("score") / band), specs)
    totals = counts.agg(F.sum("targets").alias("t"), F.sum("impostors").alias("i"))
    return summed.select(
        "score",
        "targets",
        "impostors",
        F.try_divide("below_targets", totals.select("t").scalar()).alias("fnr"),
        (1.0 - F.try_divide("below_impostors", totals.select("i").scalar())).alias("fpr"),
    )


def equal_error_rate(points: DataFrame) -> DataFrame:
    """EER by linear interpolation where the two rates cross, and its threshold."""
    gap = F.round(F.col("fnr") - F.col("fpr"), 12)
    pair = F.struct("fnr", "fpr", "score")
    ends = points.agg(
        F.min_by(pair, F.when(gap >= 0, F.col("score"))).alias("a"),
        F.max_by(pair, F.when(gap < 0, F.col("score"))).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    share = (a["fnr"] - a["fpr"]) / (b["fpr"] - a["fpr"] - (b["fnr"] - a["fnr"]))
    return ends.select(
        (a["fnr"] + share * (b["fnr"] - a["fnr"])).alias("eer"), a["score"].alias("threshold")
    )


def detection_cost(points: DataFrame, p_target: float, c_miss: float = 1.0, c_fa: float = 1.0) -> DataFrame:
    """Minimum detection cost, plain and normalised by the better trivial decision."""
    cost = c_miss * F.col("fnr") * p_target + c_fa * F.col("fpr") * (1 - p_target)
    trivial = min(c_miss * p_target, c_fa * (1 - p_target))
    return points.agg(F.min(cost).alias("min_cost"), (F.min(cost) / trivial).alias("normalised_cost"))


def binned_roc(df: DataFrame, score: str, label: str, bins: int, band: int = 4096) -> DataFrame:
    """Rates over equal-width bins between the smallest and largest score, empty bins included."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    place = F.coalesce(F.floor(F.try_divide((F.col(score) - lo) * bins, hi - lo)), F.lit(0))
    counts = (
        df.withColumn("bin", F.least(place, F.lit(bins - 1)))
        .groupBy("bin")
        .agg(
            F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("targets"),
            F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("impostors"),
        )
    )
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").na.fill(0)
    specs = {n: Running("sum", F.col(n[6:])) for n in ("below_targets", "below_impostors")}
    summed = carry.running(grid, [], ["bin"], F.floor(F.col("bin") / band), specs)
    totals = counts.agg(F.sum("targets").alias("t"), F.sum("impostors").alias("i"))
    return summed.select(
        "bin",
        F.try_divide("below_targets", totals.select("t").scalar()).alias("fnr"),
        (1.0 - F.try_divide("below_impostors", totals.select("i").scalar())).alias("fpr"),
    )


def equalising_weights(df: DataFrame, part: str, label: str) -> DataFrame:
    """Weights that give every partition the trial counts of the largest one, per label."""
    counts = df.groupBy(part, label).agg(F.count("*").alias("n"))
    most = counts.groupBy(label).agg(F.max("n").alias("most"))
    weights = counts.join(most, label).select(part, label, (F.col("most") / F.col("n")).alias("weight"))
    return df.join(weights, [part, label])


def average_precision(df: DataFrame, score: str, label: str, band: float) -> DataFrame:
    """Average precision with the precision envelope over all lower thresholds."""
    counts = df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("tp"), F.count("*").alias("n")
    )
    chunk = F.floor(F.col("score") / band)
    above = carry.running(
        counts,
        [],
        ["score"],
        chunk,
        {"tps": Running("sum", F.col("tp")), "seen": Running("sum", F.col("n"))},
        descending=True,
    ).withColumn("precision", F.col("tps") / F.col("seen"))
    envelope = carry.running(
        above, [], ["score"], chunk, {"best": Running("max", F.col("precision"))}
    )
    return envelope.agg((F.sum(F.col("tp") * F.col("best")) / F.sum("tp")).alias("average_precision"))


def value_histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram between the extremes; only the counts travel. Equal values all fall in bin 0."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    place = F.coalesce(F.floor(F.try_divide((F.col(value) - lo) * bins, hi - lo)), F.when(F.col(value).isNotNull(), F.lit(0)))
    return df.groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


#: Vectors of one block of ``cosine_histogram``; a task compares two blocks, so many rows at a time.
PAIR_BLOCK, PAIR_ROWS = 8192, 256


def cosine_histogram(df: DataFrame, key: str, vector: str, bins: int = 30) -> DataFrame:
    """Histogram of the cosines of all pairs of vectors with different keys, counted block pair by block pair.

    Vectors are dealt to blocks by key hash; each pair of blocks is one group, whose task emits bin counts,
    never pairs. Rows without a key or a vector are in no pair.
    """
    rows = df.select(F.col(key).alias("key"), V.as_doubles(F.col(vector)).alias("v")).dropna()
    blocks = F.lit(max(1, -(-rows.count() // PAIR_BLOCK)))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))
    )
    spread = placed.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "v")

    def count(group, table):
        block, keys = table["block"].to_numpy(), table["key"].to_numpy()
        matrix = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        left, right = (np.flatnonzero(block == b.as_py()) for b in group)
        same = group[0] == group[1]
        total = np.zeros(bins, dtype=np.int64)
        for start in range(0, len(left), PAIR_ROWS):
            part = left[start : start + PAIR_ROWS]
            sims = np.round(matrix[part] @ matrix[right].T, V.SCORE_DIGITS)
            if same:  # each pair once; equal keys are in one block
                sims = sims[keys[part][:, None] < keys[right][None, :]]
            place = np.clip(np.floor((sims.ravel() + 1.0) * bins / 2.0), 0, bins - 1)
            total += np.bincount(place.astype(np.int64), minlength=bins)
        return pa.table({"bin": np.arange(bins, dtype=np.int64), "n": total})

    parts = spread.groupBy("i", "j").applyInArrow(count, "bin bigint, n bigint")
    return parts.groupBy("bin").agg(F.sum("n").alias("n")).filter("n > 0")
