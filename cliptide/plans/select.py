"""End-to-end evidence selection: pool, greedy prefix, depth, ordered output."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.operators import depth, mmr, scoring


@dataclass(frozen=True)
class SelectionPlan:
    """Settings of one selector run; the presets below name the published variants."""

    candidate_pool: int = 200
    min_k: int = 2
    max_k: int = 8
    start_k: int = 2
    lambda_: float = 0.85
    relevance_mode: str = "minmax_zero"
    tie: str = "relevance"
    normalize: bool = True
    clip_lambda: bool = False
    policy: str = "calibrated"
    output_order: str = "time"


#: Stand-alone selector, caption-memory host and graph-memory host.
STANDALONE = SelectionPlan()
STANDALONE_GRAPH = SelectionPlan(max_k=5, start_k=1)
CAPTION_HOST = SelectionPlan(normalize=False, clip_lambda=True, policy="caption_host", output_order="rank")
GRAPH_HOST = SelectionPlan(
    max_k=5,
    relevance_mode="minmax_one",
    tie="first",
    clip_lambda=True,
    policy="raw_mmr_delta_root",
    output_order="clip",
)


def with_policy(plan: SelectionPlan, policy: str, **changes: object) -> SelectionPlan:
    return replace(plan, policy=policy, **changes)


def _steps(plan: SelectionPlan) -> int:
    whole = {"relative_retention_survival", "relative_retention_expected", "relative_retention_ln_expectation"}
    if plan.policy in whole:
        return plan.candidate_pool
    one_more = plan.policy in {"calibrated", "caption_host"} or "delta_root" in plan.policy
    return max(1, plan.max_k) + (1 if one_more else 0)


def _decision(plan: SelectionPlan) -> Column:
    """Depth and stop reason for a query's curve."""
    curve = F.col("curve")
    if plan.policy == "calibrated":
        return depth.calibrated_depth(curve, plan.min_k, plan.max_k, plan.start_k)
    params = depth.DepthParams(min_clips=plan.min_k, max_clips=plan.max_k)
    if plan.policy == "caption_host":
        k = depth.host_depth(curve, params, True, first=max(1, plan.start_k))
    elif plan.policy == "top_k":
        k = F.least(F.lit(plan.max_k), F.size(curve))
    else:
        k = depth.policy(
            plan.policy, curve, params, F.col("steps.relevance"), F.col("steps.redundancy")
        )
    return F.struct(k.cast("int").alias("k"), F.lit(plan.policy).alias("reason"))


def _ordered(items: Column, order: str) -> Column:
    """Sort the kept items by time (null start last), by greedy rank or by clip id."""
    lead = {
        "time": lambda x: F.struct(x["start"].isNull(), x["start"], x["clip_id"]),
        "rank": lambda x: F.struct(x["rank"]),
        "clip": lambda x: F.struct(
            F.try_to_number(x["clip_id"], F.lit("999999999999999999")).isNull(),
            F.try_to_number(x["clip_id"], F.lit("999999999999999999")),
            x["clip_id"],
        ),
    }[order]
    keyed = F.transform(items, lambda x: F.struct(lead(x).alias("key"), x.alias("item")))
    return F.transform(F.array_sort(keyed), lambda x: x["item"])


def select_evidence(scored: DataFrame, key: list[str], plan: SelectionPlan = STANDALONE) -> DataFrame:
    """One row per query: depth, stop reason, selected items, greedy trace.

    ``scored`` holds ``clip_id``, ``relevance``, ``start`` and ``vector`` per candidate; every
    other column travels with the selected items. Candidates are cut to the pool before the
    fold, so the fold's group size does not grow with the data.
    """
    pool = scoring.candidate_pool(scored, key, plan.candidate_pool)
    extra = [c for c in pool.columns if c not in {*key, "vector", "pos", "clip_id"}]
    pool = pool.withColumn("facts", F.struct(*extra))
    trace = mmr.greedy_prefix(
        pool,
        key,
        _steps(plan),
        plan.lambda_,
        relevance_mode=plan.relevance_mode,
        tie=plan.tie,
        normalize=plan.normalize,
        clip_lambda=plan.clip_lambda,
        carry=("facts",),
    )
    step = F.struct("rank", "clip_id", "relevance", "redundancy", "marginal", "facts")
    packed = trace.groupBy(*key).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    packed = packed.withColumn("curve", F.col("steps.marginal"))
    decided = packed.withColumn("decision", _decision(plan))
    item = lambda s: F.struct(
        s["clip_id"].alias("clip_id"),
        s["rank"].alias("rank"),
        s["facts"]["relevance"].alias("relevance"),
        s["facts"]["start"].alias("start"),
        s["facts"].alias("facts"),
    )
    kept = F.transform(F.slice("steps", 1, F.col("decision.k")), item)
    return decided.select(
        *key,
        F.col("decision.k").alias("selected_k"),
        F.col("decision.reason").alias("stop_reason"),
        _ordered(kept, plan.output_order).alias("selected"),
        F.transform(F.slice("steps", 1, F.col("decision.k")), lambda s: s["clip_id"]).alias("mmr_order"),
        F.transform("steps", lambda s: s.dropFields("facts")).alias("mmr_steps"),
        "curve",
    )
