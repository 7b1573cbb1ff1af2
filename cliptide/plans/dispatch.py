"""Named selectors for the caption memory and the graph memory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliptide.operators import depth, ranking
from cliptide.plans import select

#: Rank-based selectors, and the depth policy behind each curve-based one.
TOP = {"topk", "fixed", "adaptiverag"}
CURVE_SELECTORS = {
    "calibrated": "caption_host",
    "retention": "relative_retention_survival",
    "delta_root": "raw_mmr_delta_root_legacy",
    "mmr": "top_k",
}


@dataclass(frozen=True)
class CaptionSettings:
    selector: str = "calibrated"
    pool: int = 200
    min_k: int = 2
    max_k: int = 8
    start_k: int = 2
    lambda_: float = 0.85
    retrieve_more: int = 5
    route_sizes: tuple[tuple[str, int], ...] = (("A", 2), ("B", 7), ("C", 8))


def select_captions(ranked: DataFrame, key: list[str], s: CaptionSettings, labels: DataFrame | None = None) -> DataFrame:
    """Selected documents (key, clip_id, position) by the named selector.

    ``ranked`` holds clip_id, relevance, start, vector; questions without documents have no rows.
    ``labels`` (key, label) is needed by the routed selector.
    """
    order = Window.partitionBy(*key).orderBy(F.desc("relevance"), F.coalesce("start", F.lit(0.0)), "clip_id")
    pool = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.pool)
    if s.selector in {"topk", "fixed"}:
        return pool.filter(F.col("rank") <= s.max_k).select(*key, "clip_id", F.col("rank").alias("position"))
    if s.selector == "adaptiverag":
        if labels is None:
            raise ValueError("the routed selector needs labels")
        routed = ranking.routed_top_k(pool, labels, key, "rank", dict(s.route_sizes))
        return routed.select(*key, "clip_id", F.col("rank").alias("position"))
    if s.selector == "adaptivek":
        step = F.struct("rank", "relevance")
        curves = pool.groupBy(*key).agg(
            F.transform(F.array_sort(F.collect_list(step)), lambda r: r["relevance"]).alias("curve")
        )
        p = depth.DepthParams(min_clips=s.min_k, max_clips=s.max_k, retrieve_more=s.retrieve_more)
        counts = curves.select(*key, depth.adaptive_k_scaled(F.col("curve"), p).alias("k"))
        return pool.join(counts, key).filter(F.col("rank") <= F.col("k")).select(
            *key, "clip_id", F.col("rank").alias("position")
        )
    if s.selector not in CURVE_SELECTORS:
        raise ValueError(f"unknown selector: {s.selector}")
    plan = select.with_policy(
        select.CAPTION_HOST,
        CURVE_SELECTORS[s.selector],
        candidate_pool=s.pool,
        min_k=s.min_k,
        max_k=s.max_k,
        start_k=s.start_k,
        lambda_=s.lambda_,
    )
    chosen = select.select_evidence(ranked, key, plan)
    return chosen.select(*key, F.posexplode("selected").alias("p", "item")).select(
        *key, F.col("item.clip_id").alias("clip_id"), (F.col("p") + 1).alias("position")
    )


@dataclass(frozen=True)
class GraphSettings:
    """Switches of the graph memory; the first one set in the order below decides."""

    node_adaptive_k: bool = False
    diverse: bool = False
    routed: bool = False
    dynamic_policy: str = ""
    clip_adaptive_k: bool = False
    top_k: int = 2
    pool: int = 200
    min_clips: int = 2
    max_clips: int = 5
    lambda_: float = 0.85
    threshold: float = 0.5
    extra_clips: int = 0
    before_clip: int | None = None
    route_sizes: tuple[tuple[str, int], ...] = (("A", 2), ("B", 4), ("C", 5))


def select_graph_clips(
    clips: DataFrame, nodes: DataFrame, key: list[str], s: GraphSettings, labels: DataFrame | None = None
) -> DataFrame:
    """Selected clips (key, clip_id) of a graph memory.

    ``clips``: clip_id, score, vector. ``nodes``: node_id, clip_id, score. Later clips than
    ``before_clip`` are never read.
    """
    if s.before_clip is not None:
        clips = clips.filter(F.col("clip_id") <= s.before_clip)
        nodes = nodes.filter(F.col("clip_id") <= s.before_clip)
    if s.node_adaptive_k:
        return ranking.clips_from_node_curve(
            nodes, key, "score", "node_id", min_clips=s.min_clips, max_clips=s.max_clips, extra_clips=s.extra_clips
        ).select(*key, "clip_id")
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "clip_id")
    ranked = clips.withColumn("rank", F.row_number().over(order))
    if not s.diverse:
        kept = ranked.filter((F.col("rank") <= s.top_k) & (F.col("score") >= s.threshold))
        return kept.select(*key, "clip_id")
    if s.routed:
        if labels is None:
            raise ValueError("the routed selector needs labels")
        bounded = ranked.filter(F.col("rank") <= s.pool)
        return ranking.routed_top_k(bounded, labels, key, "rank", dict(s.route_sizes)).select(*key, "clip_id")
    if s.clip_adaptive_k and not s.dynamic_policy:
        bounded = ranked.filter(F.col("rank") <= s.pool)
        step = F.struct("rank", "score")
        curves = bounded.groupBy(*key).agg(
            F.transform(F.array_sort(F.collect_list(step)), lambda r: r["score"]).alias("curve")
        )
        p = depth.DepthParams(min_clips=s.min_clips, max_clips=s.max_clips)
        counts = curves.select(*key, depth.adaptive_k_raw(F.col("curve"), p, "largest_gap").alias("k"))
        limit = F.least(F.col("k") + s.extra_clips, F.lit(s.max_clips))
        return bounded.join(counts, key).filter(F.col("rank") <= limit).select(*key, "clip_id")
    plan = select.with_policy(
        select.GRAPH_HOST,
        s.dynamic_policy or "top_k",
        candidate_pool=s.pool,
        min_k=s.min_clips,
        max_k=s.max_clips if s.dynamic_policy else s.top_k,
        lambda_=s.lambda_,
    )
    if not s.dynamic_policy:
        plan = select.with_policy(plan, "top_k", min_k=1)
    scored = clips.select(
        *key, F.col("clip_id").cast("string").alias("clip_id"), F.col("score").alias("relevance"), "vector",
        F.col("clip_id").cast("double").alias("start"),
    )
    chosen = select.select_evidence(scored, key, plan)
    kind = dict(clips.dtypes)["clip_id"]
    return chosen.select(*key, F.explode("mmr_order").alias("clip_id")).withColumn("clip_id", F.col("clip_id").cast(kind))
