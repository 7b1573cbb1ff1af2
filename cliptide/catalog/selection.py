"""Selection queries over the vector table: pool, greedy prefix, depth, ordered output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.catalog.registry import big, digits, query, table
from cliptide.catalog.sqlparts import SCORED, mmr_ctes
from cliptide.operators import mmr, scoring
from cliptide.plans import select


def scored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector scored against the mean vector of its label."""
    rows = table(spark, folder, "embeddings")
    memory = rows.select(
        "label",
        "vec_id",
        F.col("vec_id").cast("string").alias("clip_id"),
        (F.lit(30.0) * F.col("vec_id")).alias("start"),
        (F.lit(30.0) * F.col("vec_id") + 30.0).alias("end"),
        F.col("embedding").alias("vector"),
    )
    queries = scoring.centroid(rows, ["label"], "embedding")
    return scoring.score_against(memory, queries, ["label"], "vector", "query_vector")


def trace_output(trace: DataFrame) -> DataFrame:
    return trace.select(
        big("label"), big("rank"), "clip_id", digits("relevance"), digits("redundancy"), digits("marginal")
    )


_TRACE_OUT = (
    "SELECT CAST(label AS BIGINT) AS label, CAST(rank AS BIGINT) AS rank, clip_id, "
    "round(relevance, 6) + 0.0 AS relevance, round(redundancy, 6) + 0.0 AS redundancy, "
    "round(marginal, 6) + 0.0 AS marginal FROM trace"
)


def depth_sql(g: str = "g", min_k: int = 2, max_k: int = 8, start_k: int = 2) -> str:
    """Calibrated depth from ``trace`` rows as ``chosen(label, k, reason)``."""
    return f"""
pairs AS (SELECT label, rank, marginal, lead(marginal) OVER (PARTITION BY label ORDER BY rank) AS nxt,
                 first_value(marginal) OVER (PARTITION BY label ORDER BY rank) AS g1,
                 count(*) OVER (PARTITION BY label) AS n FROM trace),
drops AS (SELECT label, rank AS k, (marginal - nxt) / g1 AS d, pow((marginal - nxt) / g1, 1.0 / rank) AS s
          FROM pairs WHERE g1 > 0 AND nxt IS NOT NULL AND marginal > nxt AND rank >= {start_k}
            AND rank <= least({max_k}, n)),
best AS (SELECT label, k FROM drops QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, d DESC, k) = 1),
chosen AS (SELECT p.label, CASE WHEN b.k IS NULL THEN least({max_k}, p.n)
                  ELSE least(least({max_k}, p.n), greatest(least({min_k}, least({max_k}, p.n)), b.k)) END AS k,
                  CASE WHEN b.k IS NOT NULL THEN 'calibrated_adjacent_drop'
                       WHEN p.g1 <= 0 OR least({max_k}, p.n - 1) < {start_k} THEN 'no_valid_boundary_return_max'
                       ELSE 'no_positive_drop_return_max' END AS reason
           FROM pairs p LEFT JOIN best b USING (label) WHERE p.rank = 1)
"""


@query(
    "evidence_select",
    f"""WITH {SCORED}, {mmr_ctes(9, 0.85)}, {depth_sql()},
kept AS (SELECT t.label, t.rank, t.clip_id, s.st, s.rel, c.k, c.reason FROM trace t JOIN chosen c USING (label)
         JOIN scored s ON s.label = t.label AND s.clip_id = t.clip_id WHERE t.rank <= c.k)
SELECT CAST(label AS BIGINT) AS label, CAST(k AS BIGINT) AS selected_k, reason AS stop_reason,
       CAST(row_number() OVER (PARTITION BY label ORDER BY st ASC NULLS LAST, clip_id) AS BIGINT) AS position,
       clip_id, CAST(rank AS BIGINT) AS mmr_rank, round(rel, 6) + 0.0 AS relevance, st AS start
FROM kept""",
)
def evidence_select(spark: SparkSession, folder: str) -> DataFrame:
    chosen = select.select_evidence(scored_vectors(spark, folder), ["label"], select.STANDALONE)
    rows = chosen.select(
        "label", "selected_k", "stop_reason", F.posexplode("selected").alias("place", "item")
    )
    return rows.select(
        big("label"),
        big("selected_k"),
        "stop_reason",
        (F.col("place") + 1).cast("bigint").alias("position"),
        F.col("item.clip_id").alias("clip_id"),
        F.col("item.rank").cast("bigint").alias("mmr_rank"),
        (F.round("item.relevance", 6) + 0.0).alias("relevance"),
        F.col("item.start").alias("start"),
    )


@query("mmr_prefix", f"WITH {SCORED}, {mmr_ctes(9, 0.85)} {_TRACE_OUT}")
def mmr_prefix(spark: SparkSession, folder: str) -> DataFrame:
    pool = scoring.candidate_pool(scored_vectors(spark, folder), ["label"], 200)
    return trace_output(mmr.greedy_prefix(pool, ["label"], 9, 0.85))


@query(
    "mmr_prefix_graph",
    f"WITH {SCORED}, {mmr_ctes(6, 0.75, scaling='minmax_one', tie_first=True)} {_TRACE_OUT}",
)
def mmr_prefix_graph(spark: SparkSession, folder: str) -> DataFrame:
    pool = scoring.candidate_pool(scored_vectors(spark, folder), ["label"], 200)
    trace = mmr.greedy_prefix(
        pool, ["label"], 6, 0.75, relevance_mode="minmax_one", tie="first", clip_lambda=True
    )
    return trace_output(trace)


@query("mmr_raw", f"WITH {SCORED}, {mmr_ctes(9, 0.85, scaling='raw')} {_TRACE_OUT}")
def mmr_raw(spark: SparkSession, folder: str) -> DataFrame:
    pool = scoring.candidate_pool(scored_vectors(spark, folder), ["label"], 200)
    trace = mmr.greedy_prefix(
        pool, ["label"], 9, 0.85, relevance_mode="raw", normalize=False, clip_lambda=True
    )
    return trace_output(trace)


@query(
    "mmr_distance",
    f"WITH {SCORED}, {mmr_ctes(6, 0.7, scaling='minmax_one', tie_first=True, distance=True)} {_TRACE_OUT}",
)
def mmr_distance(spark: SparkSession, folder: str) -> DataFrame:
    pool = scoring.candidate_pool(scored_vectors(spark, folder), ["label"], 200)
    trace = mmr.greedy_prefix(
        pool, ["label"], 6, 0.7, relevance_mode="minmax_one", tie="first", objective="distance"
    )
    return trace_output(trace)
