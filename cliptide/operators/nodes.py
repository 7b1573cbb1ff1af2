"""Fold fine-grained memory nodes into one candidate per clip.

Nodes are cut to ``top_nodes`` per clip in Catalyst, so the fold works on a short array per clip
and stays inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliptide.functions import vectors as V
from cliptide.functions.arrays import let


@dataclass(frozen=True)
class NodeSettings:
    """Published settings of the node-to-clip aggregation."""

    top_nodes: int = 8
    max_leaders: int = 4
    type_window: int = 3
    cluster_threshold: float = 0.85
    eta: float = 1e-3
    leader_weights: tuple[float, ...] = (1.0, 0.35, 0.15, 0.05)
    type_bonus: float = 0.05
    coverage_weight: float = 0.03
    coverage_cap: int = 3


_CLUSTER = (
    "array<struct<total:array<double>,weight:double,centre:array<double>,"
    "lead:double,node:string,kind:string>>"
)


def _cluster(total: Column, weight: Column, lead: Column, node: Column, kind: Column) -> Column:
    return F.struct(
        total.alias("total"),
        weight.alias("weight"),
        V.normalize(total).alias("centre"),
        lead.alias("lead"),
        node.alias("node"),
        kind.alias("kind"),
    )


def leader_clusters(nodes: Column, threshold: float, eta: float) -> Column:
    """Online leader clustering of an ordered node array, strongest leader first."""

    def step(acc: Column, n: Column) -> Column:
        weight = F.greatest(n["relevance"], F.lit(eta))
        weighted = F.transform(n["vector"], lambda x: x * weight)
        opened = F.concat(
            acc, F.array(_cluster(weighted, weight, n["relevance"], n["node_id"], n["memory_type"]))
        )
        nearest = F.array_max(
            F.transform(
                acc,
                lambda c, i: F.struct(
                    F.round(V.dot(n["vector"], c["centre"]), V.SCORE_DIGITS).alias("sim"),
                    (-i).alias("neg"),
                ),
            )
        )

        def join(best: Column) -> Column:
            def merge(c: Column, i: Column) -> Column:
                better = n["relevance"] > c["lead"]
                grown = _cluster(
                    F.zip_with(c["total"], weighted, lambda x, y: x + y),
                    c["weight"] + weight,
                    F.when(better, n["relevance"]).otherwise(c["lead"]),
                    F.when(better, n["node_id"]).otherwise(c["node"]),
                    F.when(better, n["memory_type"]).otherwise(c["kind"]),
                )
                return F.when(i == -best["neg"], grown).otherwise(c)

            fits = best["sim"] >= threshold
            return F.when(fits, F.transform(acc, merge)).otherwise(opened)

        return let(nearest, lambda b: F.when(b.isNull(), opened).otherwise(join(b))).cast(_CLUSTER)

    folded = F.aggregate(nodes, F.array().cast(_CLUSTER), step)
    keyed = F.transform(
        folded, lambda c, i: F.struct((-c["lead"]).alias("a"), i.alias("b"), c.alias("c"))
    )
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def aggregate_nodes(nodes: DataFrame, key: list[str], s: NodeSettings | None = None) -> DataFrame:
    """One candidate per (query, clip): relevance, vector, text, time span and node facts.

    ``nodes`` has node_id, clip_id, relevance, vector, memory_type, text, start, end and a
    ``seq`` giving the input order (ties on relevance keep it).
    """
    s = s or NodeSettings()
    order = Window.partitionBy(*key, "clip_id").orderBy(F.desc("relevance"), F.asc("seq"))
    cut = nodes.withColumn("__rn", F.row_number().over(order)).filter(
        F.col("__rn") <= max(1, s.top_nodes)
    )
    item = F.struct(
        F.col("__rn").alias("rn"),
        F.col("node_id").cast("string").alias("node_id"),
        F.col("relevance").cast("double").alias("relevance"),
        V.normalize(F.col("vector")).alias("vector"),
        F.coalesce("memory_type", F.lit("")).alias("memory_type"),
        F.coalesce("text", F.lit("")).alias("text"),
        "start",
        "end",
    )
    packed = cut.groupBy(*key, "clip_id").agg(F.array_sort(F.collect_list(item)).alias("nodes"))
    clustered = packed.withColumn(
        "clusters", leader_clusters(F.col("nodes"), s.cluster_threshold, s.eta)
    )
    count = min(s.max_leaders, len(s.leader_weights))
    weights = F.array(*[F.lit(float(w)) for w in s.leader_weights[:count]])
    leaders = F.slice("clusters", 1, count)
    weighted = F.zip_with(
        leaders,
        F.slice(weights, 1, F.size(leaders)),
        lambda c, w: F.struct(
            (w * c["lead"]).alias("score"),
            F.transform(c["centre"], lambda x: x * w * F.greatest(c["lead"], F.lit(s.eta))).alias("part"),
        ),
    )
    kinds = F.array_sort(
        F.array_distinct(
            F.filter(
                F.transform(F.slice("clusters", 1, s.type_window), lambda c: c["kind"]),
                lambda k: k != "",
            )
        )
    )
    both = F.array_contains(kinds, "episodic") & F.array_contains(kinds, "semantic")
    coverage = s.coverage_weight * F.least(F.size("clusters") - 1, F.lit(s.coverage_cap))
    relevance = (
        F.aggregate(weighted, F.lit(0.0), lambda acc, w: acc + w["score"])
        + F.when(both, F.lit(s.type_bonus)).otherwise(F.lit(0.0))
        + coverage
    )
    zero = F.transform(F.element_at("nodes", 1)["vector"], lambda x: F.lit(0.0))
    summed = F.aggregate(
        weighted, zero, lambda acc, w: F.zip_with(acc, w["part"], lambda x, y: x + y)
    )
    return clustered.select(
        *key,
        "clip_id",
        relevance.alias("relevance"),
        V.normalize(summed).alias("vector"),
        F.array_join(
            F.filter(F.transform("nodes", lambda n: n["text"]), lambda t: t != ""), "\n"
        ).alias("text"),
        F.array_min(F.transform("nodes", lambda n: n["start"])).alias("start"),
        F.array_max(F.transform("nodes", lambda n: n["end"])).alias("end"),
        F.struct(
            F.transform("nodes", lambda n: n["node_id"]).alias("node_ids"),
            F.size("clusters").alias("cluster_count"),
            F.transform(leaders, lambda c: c["node"]).alias("cluster_leaders"),
            kinds.alias("memory_types"),
        ).alias("metadata"),
    )


def clip_scores(nodes: DataFrame, key: list[str], mode: str) -> DataFrame:
    """Score a clip by the sum, maximum or mean of its node scores."""
    builders = {"sum": F.sum, "max": F.max, "mean": F.avg}
    if mode not in builders:
        raise ValueError(f"unknown clip score mode: {mode}")
    return nodes.groupBy(*key, "clip_id").agg(builders[mode]("relevance").alias("score"))


def scene_boost(
    clips: DataFrame, scenes: DataFrame, key: list[str], weight: float, floor: float = 0.3, reach: int = 5
) -> DataFrame:
    """Add ``weight * sim`` to the clips in [scene - reach, scene] of each similar scene.

    The band is unrolled into ``reach + 1`` equal keys and summed before the join.
    """
    offsets = F.explode(F.sequence(F.col("scene_clip") - reach, F.col("scene_clip")))
    gains = (
        scenes.filter(F.col("sim") > floor)
        .select(*key, offsets.alias("clip_id"), (weight * F.col("sim")).alias("gain"))
        .groupBy(*key, "clip_id")
        .agg(F.sum("gain").alias("gain"))
    )
    boosted = clips.join(gains, [*key, "clip_id"], "left")
    return boosted.withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0))).drop("gain")
