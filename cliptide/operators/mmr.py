"""Greedy, diversity-aware ordering of a bounded candidate pool.

Each step depends on the previous one, so a pool (at most ``candidate_pool`` rows, cut in
Catalyst beforehand) is folded in one Arrow call; Spark shuffles and spreads the queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cliptide.functions.vectors import SCORE_DIGITS

_TRACE = "rank int, clip_id string, relevance double, redundancy double, marginal double"


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(rows, -1)


def _counts(column: pa.ChunkedArray) -> np.ndarray:
    """Token counts per row over the tokens of all rows (one empty column without any token)."""
    bags = column.combine_chunks()
    length = np.asarray([len(b) for b in bags])
    codes = bags.flatten().dictionary_encode()
    out = np.zeros((len(bags), max(1, len(codes.dictionary))))
    np.add.at(out, (np.repeat(np.arange(len(bags)), length), codes.indices.to_numpy()), 1.0)
    return out


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.where(length <= 1e-12, matrix, matrix / np.maximum(length, 1e-12))


def _scaled(relevance: np.ndarray, mode: str) -> np.ndarray:
    if mode == "raw":
        return relevance
    low, high = relevance.min(), relevance.max()
    if high <= low:
        return np.full_like(relevance, 1.0 if mode == "minmax_one" else 0.0)
    return (relevance - low) / max(high - low, 1e-12)


def _walk(
    relevance: np.ndarray, vectors: np.ndarray, steps: int, lambda_: float, tie: str, objective: str
) -> list[tuple[int, float, float]]:
    """Return (row, redundancy, score) per step, keeping running redundancy per row."""
    chosen: list[tuple[int, float, float]] = []
    alive = np.ones(len(relevance), dtype=bool)
    running = np.full(len(relevance), -np.inf)
    mean_sum = np.zeros(vectors.shape[1])
    for _ in range(min(steps, len(relevance))):
        if not chosen:
            penalty = np.zeros(len(relevance))
            score = relevance.copy()
        elif objective == "distance":
            length = np.linalg.norm(mean_sum)
            centre = mean_sum / length if length > 1e-12 else mean_sum
            penalty = np.round(np.linalg.norm(vectors - centre, axis=1) / 2.0, SCORE_DIGITS)
            score = lambda_ * relevance + (1.0 - lambda_) * penalty
        else:
            penalty = running
            score = lambda_ * relevance - (1.0 - lambda_) * penalty
        score = np.round(score, SCORE_DIGITS)
        rows = np.flatnonzero(alive)
        if tie == "first":
            best = rows[np.argmax(score[rows])]
        else:
            best = rows[np.lexsort((rows, -relevance[rows], -score[rows]))[0]]
        chosen.append((int(best), float(penalty[best]), float(score[best])))
        alive[best] = False
        mean_sum = mean_sum + vectors[best]
        running = np.maximum(running, np.round(vectors @ vectors[best], SCORE_DIGITS))
    return chosen


def greedy_prefix(
    pool: DataFrame,
    key: list[str],
    steps: int,
    lambda_: float,
    *,
    relevance_mode: str = "minmax_zero",
    tie: str = "relevance",
    normalize: bool = True,
    objective: str = "redundancy",
    clip_lambda: bool = False,
    carry: tuple[str, ...] = (),
    bags: str | None = None,
) -> DataFrame:
    """Ordered prefix per query with the trace of every step.

    ``bags`` names a token-array column: token counts over the pool's own vocabulary then take the
    place of ``vector``.
    ``carry`` names pool columns that travel with the chosen rows, so nothing is joined back.

    ``relevance_mode``: ``minmax_zero`` / ``minmax_one`` (value of an all-equal pool) or ``raw``.
    ``tie``: ``relevance`` (score, relevance, earlier row) or ``first`` (earlier row).
    ``objective``: ``redundancy`` (max cosine to the selection) or ``distance`` (distance to its mean).
    """
    if clip_lambda:
        lambda_ = min(1.0, max(0.0, lambda_))
    if not 0.0 <= lambda_ <= 1.0:
        raise ValueError("lambda_ must be in [0, 1]")
    types = dict(pool.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in key), _TRACE, *(f"{c} {types[c]}" for c in carry)])

    # the declared schema has nullable fields throughout, whatever the pool's flags
    carried = {c: to_arrow_type(T.StructType.fromDDL(f"c {types[c]}")["c"].dataType) for c in carry}

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        rows = table.num_rows
        relevance = np.round(_scaled(table["relevance"].to_numpy(), relevance_mode), SCORE_DIGITS)
        vectors = _counts(table[bags]) if bags else _matrix(table["vector"], rows)
        if normalize:
            vectors = _unit_rows(vectors)
        path = _walk(relevance, vectors, steps, lambda_, tie, objective)
        order = [step[0] for step in path]
        out = {k: table[k].take(order) for k in key}
        out["rank"] = pa.array(range(1, len(path) + 1), pa.int32())
        out["clip_id"] = table["clip_id"].take(order)
        out["relevance"] = pa.array(relevance[order], pa.float64())
        out["redundancy"] = pa.array([step[1] for step in path], pa.float64())
        out["marginal"] = pa.array([step[2] for step in path], pa.float64())
        for c in carry:
            out[c] = table[c].take(order).cast(carried[c])
        return pa.table(out)

    slim = pool.select(*key, "pos", "clip_id", "relevance", bags or "vector", *carry)
    if steps <= 0:
        return slim.limit(0).groupBy(*key).applyInArrow(fold, schema)
    return slim.groupBy(*key).applyInArrow(fold, schema)


def curve(trace: DataFrame, key: list[str]) -> DataFrame:
    """Fold trace rows into one row per query holding the ordered score curves."""
    step = F.struct("rank", "clip_id", "relevance", "redundancy", "marginal")
    packed = trace.groupBy(*key).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return packed.withColumn("curve", F.col("steps.marginal"))
