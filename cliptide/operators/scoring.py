"""Query-to-memory scoring, pool cuts and top-k (exact, no pair is dropped)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliptide.functions import vectors as V
from cliptide.session import broadcast_when_small, cut_lineage

#: Generous size of one stored query with its vector when a broadcast is checked.
QUERY_BYTES = 32_768


def centroid(df: DataFrame, keys: list[str], vector: str, name: str = "query_vector") -> DataFrame:
    """Mean vector per key, position by position.

    The average has a map-side partial step, so a hot key shuffles one row per task and
    position whatever its number of vectors.
    """
    cells = df.select(*keys, F.posexplode(V.as_doubles(F.col(vector))).alias("pos", "x"))
    means = cells.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("cells"))
    return packed.select(*keys, F.transform("cells", lambda c: c["x"]).alias(name))


def score_against(
    memory: DataFrame, queries: DataFrame, scope: list[str], vector: str, query_vector: str
) -> DataFrame:
    """Attach the cosine relevance of every memory row to the queries of its scope.

    The queries are stored and counted first. If they fit, they are broadcast and the memory is
    scored where it is read, without a shuffle; otherwise both sides are joined on the scope.
    """
    stored = cut_lineage(queries.withColumn(query_vector, V.normalize(F.col(query_vector))))
    prepared = broadcast_when_small(stored, QUERY_BYTES)
    joined = memory.join(prepared, scope)
    unit = joined.withColumn(vector, V.normalize(F.col(vector)))
    score = F.round(V.dot(F.col(vector), F.col(query_vector)), V.SCORE_DIGITS)
    return unit.withColumn("relevance", score + F.lit(0.0)).drop(query_vector)


def candidate_pool(scored: DataFrame, key: list[str], size: int = 200) -> DataFrame:
    """Best ``size`` candidates per query: relevance, then start (nulls last), then text id.

    ``row_number`` with a bound becomes a per-task limit before the shuffle, so a query whose
    scope holds a third of all rows still sends only ``size`` rows per task.
    """
    order = [F.desc("relevance"), F.col("start").asc_nulls_last(), F.col("clip_id").asc()]
    ranked = scored.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter(F.col("pos") <= max(0, int(size)))


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def confident_top1(df: DataFrame, key: list[str], score: str, tie: str, margin: float) -> DataFrame:
    """Best row per key, kept only when it beats the runner-up by ``margin``."""
    best_two = top_k(df, key, [F.desc(score), F.asc(tie)], 2)
    paired = best_two.groupBy(*key).agg(
        F.max(F.when(F.col("rank") == 1, F.col(tie))).alias(tie),
        F.max(F.when(F.col("rank") == 1, F.col(score))).alias("best"),
        F.max(F.when(F.col("rank") == 2, F.col(score))).alias("second"),
    )
    gap = F.round(F.col("best") - F.col("second"), V.SCORE_DIGITS)
    return paired.filter(F.col("second").isNull() | (gap >= margin))


def average_similarity(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, on: list[str], vector: str
) -> DataFrame:
    """Mean of all pairwise cosines between two groups of vectors that share ``on``.

    The mean over pairs equals the dot product of the two mean unit vectors, so no pair is formed.
    """
    def mean_unit(df: DataFrame, key: str, name: str) -> DataFrame:
        unit = df.withColumn(vector, V.normalize(F.col(vector)))
        return centroid(unit, list(dict.fromkeys([*on, key])), vector, name)

    both = mean_unit(left, left_key, "left_mean").join(mean_unit(right, right_key, "right_mean"), on)
    score = F.round(V.dot(F.col("left_mean"), F.col("right_mean")), V.SCORE_DIGITS) + F.lit(0.0)
    return both.withColumn("similarity", score).drop("left_mean", "right_mean")


def search_entities(
    nodes: DataFrame, queries: DataFrame, scope: list[str], node: str, vector: str, threshold: float
) -> DataFrame:
    """(scope, node, similarity, rank): nodes whose mean cosine over all pairs with the query vectors of their scope
    reaches ``threshold``, best first, ties to the smaller node."""
    means = average_similarity(nodes, queries, node, scope[0], scope, vector)
    found = means.filter(F.col("similarity") >= threshold).select(*scope, node, "similarity")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("similarity"), node)))


def search_nodes(
    nodes: DataFrame, queries: DataFrame, scope: list[str], node: list[str], vector: str, query_vector: str, mode: str = "max"
) -> DataFrame:
    """Score nodes that own several vectors against a question with several query vectors.

    ``max``, ``min`` and ``mean`` run over all (query, vector) cosines; ``sum`` averages over a
    node's vectors and adds up the queries. The ``queries`` of a scope are packed into one row, so a
    node vector is read once and no pair is emitted; the size check goes by the longest such row.
    """
    per_row = {
        "max": (F.array_max, F.max),
        "min": (F.array_min, F.min),
        "mean": (lambda sims: F.aggregate(sims, F.lit(0.0), lambda a, x: a + x) / F.size(sims), F.avg),
        "sum": (lambda sims: F.aggregate(sims, F.lit(0.0), lambda a, x: a + x), F.avg),
    }
    if mode not in per_row:
        raise ValueError(f"unknown search mode: {mode}")
    reduce_row, reduce_node = per_row[mode]
    packed = queries.groupBy(*scope).agg(F.collect_list(V.normalize(F.col(query_vector))).alias("__queries"))
    stored = cut_lineage(packed)
    most = stored.agg(F.coalesce(F.max(F.size("__queries")), F.lit(1)).alias("most")).first().most
    stored = broadcast_when_small(stored, QUERY_BYTES * most)
    joined = nodes.join(stored, scope).withColumn("__v", V.normalize(F.col(vector)))
    sims = F.transform("__queries", lambda q: F.round(V.dot(F.col("__v"), q), V.SCORE_DIGITS))
    scored = joined.withColumn("__score", reduce_row(sims))
    return scored.groupBy(*scope, *[n for n in node if n not in scope]).agg(reduce_node("__score").alias("score"))
