"""Depth policies: how many items of a ranked list to keep, from the shape of its score curve.

A curve is one ARRAY<DOUBLE> per query (bounded by the candidate pool), so every policy is a
plain column expression: no shuffle, no Python worker. ``policy`` looks a policy up by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliptide.functions import arrays as A
from cliptide.functions.arrays import at, let


@dataclass(frozen=True)
class DepthParams:
    """Limits and tuning values; the defaults are the published settings."""

    min_clips: int = 2
    max_clips: int = 5
    start_k: int = 2
    stop_threshold: float = 0.05
    confidence_threshold: float = 0.30
    ambiguity_gap: float = 0.25
    knee_min_drop: float = 0.25
    knee_alpha: float = 1.0
    uncertainty_alpha: float = 1.0
    utility_alpha: float = 0.0
    mass: float = 0.80
    hazard_quantile: float = 0.60
    gap_quantile: float = 0.5
    survival_gamma: float = 1.0
    decision: str = ""
    gate_alpha: float = 1.0
    gate_min_rank: int = 3
    tail_alpha: float = 0.5
    tail_min_rank: int = 3
    tail_min_keep: int = 2
    max_extra: int = 2
    plateau_alpha: float = 0.0
    window: int = 3
    ignore_head: float = 0.0
    ignore_tail: float = 0.0
    retrieve_more: float = 0.0


def clamp(count: Column, n: Column, low: int, high: int) -> Column:
    """Count limited to [low, high] and to the number of items, zero for an empty list."""
    upper = F.least(F.lit(high), n)
    lower = F.least(F.greatest(F.lit(1), F.lit(low)), upper)
    return F.when(n <= 0, F.lit(0)).otherwise(F.greatest(lower, F.least(upper, count)).cast("int"))


def head(curve: Column, p: DepthParams) -> Column:
    """The part of the curve a capped policy looks at."""
    return F.slice(curve, 1, max(p.min_clips, p.max_clips))


def _half_up(value: Column) -> Column:
    return F.floor(F.round(value, 9) + 0.5)


def boundary_scores(curve: Column, first: int, last: Column, by_first: bool) -> Column:
    """Length-normalised boundary strength for each depth, as (score, drop, -k) structs."""

    def one(k: Column) -> Column:
        raw = F.get(curve, k - 1) - F.get(curve, k)
        drop = raw / F.get(curve, F.lit(0)) if by_first else F.greatest(raw, F.lit(1e-12))
        return F.struct(F.power(drop, 1.0 / k).alias("score"), drop.alias("drop"), (-k).alias("neg_k"))

    rows = F.transform(A.positions(first, last), one)
    return F.filter(rows, lambda r: r["drop"] > 0) if by_first else rows


def calibrated_depth(curve: Column, min_k: int = 2, max_k: int = 8, start_k: int = 2) -> Column:
    """Depth and stop reason from length-calibrated adjacent drops."""
    n = F.size(curve)
    top = F.least(F.greatest(F.lit(max_k), F.lit(1)), n)
    last = F.least(top, n - 1)
    first = max(1, start_k)
    no_boundary = (at(curve, 1) <= 0) | (last < first)

    def decide(rows: Column) -> Column:
        best = -F.array_max(rows)["neg_k"]
        bounded = F.least(top, F.greatest(F.least(top, F.lit(max(1, min_k))), best))
        return (
            F.when(n <= 0, F.struct(F.lit(0).alias("k"), F.lit("empty_candidates").alias("reason")))
            .when(no_boundary, F.struct(top.alias("k"), F.lit("no_valid_boundary_return_max").alias("reason")))
            .when(
                F.size(rows) == 0,
                F.struct(top.alias("k"), F.lit("no_positive_drop_return_max").alias("reason")),
            )
            .otherwise(F.struct(bounded.alias("k"), F.lit("calibrated_adjacent_drop").alias("reason")))
        )

    safe = F.when(no_boundary, F.lit(-1)).otherwise(last)
    return let(boundary_scores(curve, first, safe, True), decide)


def host_depth(curve: Column, p: DepthParams, by_first: bool, first: int | None = None) -> Column:
    """Variant that starts at ``min_clips`` and returns the minimum when boundaries are missing."""
    n = F.size(curve)
    low = F.least(F.greatest(F.lit(p.min_clips), F.lit(1)), F.least(F.lit(p.max_clips), n))
    top = F.greatest(low, F.least(F.lit(p.max_clips), n))
    start = first if first is not None else max(1, p.min_clips)
    last = F.least(top, n - 1)
    positive = at(curve, 1) > 0

    def decide(rows: Column) -> Column:
        best = -F.array_max(rows)["neg_k"]
        fallback = F.when(last >= start, top).otherwise(low) if by_first else low
        return F.when(F.size(rows) > 0, F.least(top, F.greatest(low, best))).otherwise(fallback)

    reach = F.when(positive, last).otherwise(F.lit(-1)) if by_first else last
    body = let(boundary_scores(curve, start, reach, by_first), decide)
    return F.when(n <= 0, F.lit(0)).otherwise(body).cast("int")


def bic_boundary(curve: Column, p: DepthParams) -> Column:
    """Linear fit against every two-mean split, by the Bayesian information criterion."""
    y = A.running_min(head(curve, p))

    def decide(y: Column) -> Column:
        n = F.size(y)
        x = F.transform(A.positions(1, n), lambda i: i.cast("double"))
        sxx = A.squared_error(x)
        mx, my = A.mean(x), A.mean(y)
        sxy = A.total(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)))
        syy = A.squared_error(y)
        linear_sse = F.greatest(syy - sxy * sxy / sxx, F.lit(0.0))

        def bic(sse: Column, params: int) -> Column:
            return F.round(n * F.log(sse / n + 1e-8) + params * F.log(n), 9)

        splits = F.transform(
            A.positions(max(1, p.min_clips), n - 1),
            lambda k: F.struct(
                bic(
                    A.squared_error(F.slice(y, 1, k))
                    + A.squared_error(F.slice(y, k + 1, F.greatest(n - k, F.lit(0)))),
                    3,
                ).alias("bic"),
                k.alias("k"),
            ),
        )
        smooth = F.struct(bic(linear_sse, 2).alias("bic"), n.alias("k"))
        best = let(
            F.array_min(splits),
            lambda s: F.when(s["bic"] < smooth["bic"], s["k"]).otherwise(n),
        )
        picked = F.when(n <= 1, n).when(F.size(splits) == 0, n).otherwise(best)
        return clamp(picked, n, 1, p.max_clips)

    return let(y, decide)


def _scaled_policy(
    curve: Column, p: DepthParams, pick: Callable[[Column, Column], Column], whole: bool = False
) -> Column:
    """Smooth, scale, let ``pick(values, n)`` choose, clamp; a single item is kept."""
    source = curve if whole else head(curve, p)
    smooth = let(A.running_min(source), lambda s: A.scaled(s))

    def decide(values: Column) -> Column:
        n = F.size(values)
        return clamp(F.when(n <= 1, n).otherwise(pick(values, n)), n, p.min_clips, p.max_clips)

    return let(smooth, decide)


def largest_gap_cut(curve: Column, p: DepthParams) -> Column:
    return _scaled_policy(curve, p, lambda v, n: A.best_index(A.adjacent_drops(v)))


def two_segment_change(curve: Column, p: DepthParams) -> Column:
    def pick(v: Column, n: Column) -> Column:
        splits = F.transform(
            A.positions(max(1, p.min_clips), n - 1),
            lambda k: F.struct(
                F.round(
                    A.squared_error(F.slice(v, 1, k))
                    + A.squared_error(F.slice(v, k + 1, F.greatest(n - k, F.lit(0)))),
                    12,
                ).alias("sse"),
                k.alias("k"),
            ),
        )
        return F.coalesce(F.array_min(splits)["k"], F.lit(p.min_clips))

    return _scaled_policy(curve, p, pick)


def budgeted_utility(curve: Column, p: DepthParams) -> Column:
    def pick(v: Column, n: Column) -> Column:
        floor = F.round(A.mean(v) - p.utility_alpha * A.std(v), 12)
        start = F.least(F.lit(p.min_clips), n)

        def extend(floor: Column) -> Column:
            rest = F.slice(v, start + 1, F.greatest(n - start, F.lit(0)))
            stop = A.first_index(rest, lambda x: F.round(x, 12) < floor)
            return start + F.coalesce(stop - 1, F.size(rest))

        return let(floor, extend)

    return _scaled_policy(curve, p, pick)


def _mass_crossing(weights: Column, rho: float) -> Column:
    """Smallest prefix whose cumulative weight reaches ``rho``."""
    sums = A.running_sum(weights)
    return let(
        sums,
        lambda c: F.coalesce(A.first_index(c, lambda x: F.round(x, 12) >= rho), F.size(c) + 1),
    )


def utility_mass(curve: Column, p: DepthParams) -> Column:
    def pick(v: Column, n: Column) -> Column:
        weights = let(
            A.total(v),
            lambda t: F.transform(v, lambda x: F.when(t <= 1e-12, 1.0 / n).otherwise(x / t)),
        )
        return _mass_crossing(weights, p.mass)

    return _scaled_policy(curve, p, pick)


def softmax_mass(curve: Column, p: DepthParams) -> Column:
    def pick(v: Column, n: Column) -> Column:
        mad = let(A.median(v), lambda m: A.median(F.transform(v, lambda x: F.abs(x - m))))
        temperature = F.greatest(F.lit(0.10), 1.4826 * mad)
        raw = let(
            F.struct(temperature.alias("t"), F.array_max(v).alias("top")),
            lambda b: F.transform(v, lambda x: F.exp((x - b["top"]) / b["t"])),
        )
        weights = let(raw, lambda r: let(A.total(r), lambda t: F.transform(r, lambda x: x / t)))
        return _mass_crossing(weights, p.mass)

    return _scaled_policy(curve, p, pick)


def adaptive_k_raw(curve: Column, p: DepthParams, strategy: str) -> Column:
    """Adaptive-k threshold on the relevance curve sorted downwards."""
    ranked = F.reverse(F.array_sort(curve))

    def cut(gaps: Column, offset: int = 0) -> Column:
        """Position (from zero) of the steepest fall within the searched range."""
        m = F.size(gaps)
        begin = F.greatest(F.lit(0), F.least(m - 1, F.floor(m * F.lit(p.ignore_head)).cast("int")))
        tail = F.greatest(
            F.lit(0), F.least(m - begin - 1, F.floor(m * F.lit(p.ignore_tail)).cast("int"))
        )
        part = F.slice(gaps, begin + 1, F.greatest(m - tail - begin, F.lit(0)))
        lowest = let(part, lambda q: A.best_index(F.transform(q, lambda x: F.round(-x, 12))))
        return F.when(m <= 0, F.lit(0)).otherwise(lowest - 1 + begin)

    def steps(values: Column) -> Column:
        return F.transform(
            A.positions(1, F.size(values) - 1), lambda i: F.get(values, i) - F.get(values, i - 1)
        )

    def largest(v: Column) -> Column:
        return let(steps(v), cut)

    def moving(v: Column) -> Column:
        w = max(2, p.window)
        averages = F.transform(
            A.positions(1, F.size(v) - (w - 1)), lambda i: A.total(F.slice(v, i, w)) / w
        )
        return F.when(F.size(v) < w + 1, largest(v)).otherwise(let(averages, largest))

    def second(v: Column) -> Column:
        m = F.size(v) - 1
        begin = F.greatest(F.lit(0), F.least(m - 1, F.floor(m * F.lit(p.ignore_head)).cast("int")))
        tail = F.greatest(
            F.lit(0), F.least(m - begin - 1, F.floor(m * F.lit(p.ignore_tail)).cast("int"))
        )
        part = F.slice(v, begin + 1, F.greatest(m - tail - begin + 1, F.lit(0)))
        bends = let(steps(part), lambda d: F.transform(steps(d), lambda x: F.round(x, 12)))
        spike = let(
            bends,
            lambda b: F.get(
                F.filter(
                    A.positions(2, F.size(b)),
                    lambda i: (F.get(b, i - 1) > 0) & (F.array_min(F.slice(b, 1, i - 1)) < 0),
                ),
                F.lit(0),
            ),
        )
        return F.when(F.size(v) <= 3, largest(v)).otherwise(F.coalesce(spike + begin, largest(v)))

    chooser = {"largest_gap": largest, "moving_avg": moving, "2diff_spike": second}[strategy]

    def decide(v: Column) -> Column:
        threshold = F.when(F.size(v) <= 1, F.lit(0)).otherwise(chooser(v))
        if p.retrieve_more:
            factor = F.lit(p.retrieve_more)
            more = threshold * factor if isinstance(p.retrieve_more, float) else threshold + factor
            threshold = F.floor(more)
        return clamp(threshold + 1, F.size(v), p.min_clips, p.max_clips)

    return let(ranked, decide)


def adaptive_k_scaled(curve: Column, p: DepthParams) -> Column:
    """Largest gap of the smoothed, scaled relevance curve plus ``retrieve_more``."""
    smooth = let(A.running_min(curve), lambda s: A.scaled(s, 1e-12))

    def decide(v: Column) -> Column:
        n = F.size(v)
        gap = A.best_index(A.adjacent_drops(v)) + max(0, int(p.retrieve_more))
        picked = F.when(n <= 1, n).otherwise(gap)
        top = F.least(F.lit(max(1, p.max_clips)), n)
        return F.least(top, F.greatest(F.least(F.lit(max(0, p.min_clips)), top), picked)).cast("int")

    return let(smooth, decide)


def _retention_logs(v: Column) -> Column:
    """Per rank, the log-probability of stopping there divided by the rank."""
    n = F.size(v)
    keep = F.transform(
        A.positions(1, n - 1),
        lambda i: F.least(
            F.lit(1.0),
            F.greatest(
                F.lit(0.0), F.get(v, i) / F.greatest(F.abs(F.get(v, i - 1)), F.lit(1e-12))
            ),
        ),
    )

    def logs(keep: Column) -> Column:
        survive = F.transform(keep, lambda x: F.log(F.greatest(x, F.lit(1e-12))))

        def at_rank(survive: Column) -> Column:
            return F.transform(
                A.positions(1, n),
                lambda r: (
                    A.total(F.slice(survive, 1, r - 1))
                    + F.when(
                        r < n, F.log(F.greatest(1.0 - F.get(keep, r - 1), F.lit(1e-12)))
                    ).otherwise(F.lit(0.0))
                )
                / r,
            )

        return let(survive, at_rank)

    return let(keep, logs)


def retention_survival(curve: Column, p: DepthParams) -> Column:
    def pick(v: Column, n: Column) -> Column:
        scores = F.transform(_retention_logs(v), lambda x: F.round(F.exp(x), 12))
        return let(scores, A.best_index)

    return _scaled_policy(curve, p, pick, whole=True)


def _rounded(value: Column, decision: str, default: str) -> Column:
    mode = decision or default
    if mode == "ceil":
        return F.ceil(F.round(value, 9))
    if mode == "floor":
        return F.floor(F.round(value, 9))
    return _half_up(value)


def retention_expected(curve: Column, p: DepthParams) -> Column:
    def pick(v: Column, n: Column) -> Column:
        top = F.greatest(F.abs(F.get(v, F.lit(0))), F.lit(1e-12))
        return _rounded(A.total(v) / top, p.decision, "round")

    return _scaled_policy(curve, p, pick, whole=True)


def retention_ln_expectation(curve: Column, p: DepthParams) -> Column:
    def pick(v: Column, n: Column) -> Column:
        def expect(w: Column) -> Column:
            hits = F.transform(A.positions(1, F.size(w)), lambda i: i * F.get(w, i - 1))
            return A.total(hits) / F.greatest(A.total(w), F.lit(1e-12))

        weights = F.transform(_retention_logs(v), lambda x: F.exp(x))
        return _rounded(let(weights, expect), p.decision, "ceil")

    return _scaled_policy(curve, p, pick, whole=True)


def adaptive_uncertainty(curve: Column, p: DepthParams) -> Column:
    """Bonus clips for an isolated first clip and for close followers."""
    drops = let(
        A.running_min(head(curve, p)),
        lambda s: F.transform(A.relative_drops(s), lambda x: F.round(x, 12)),
    )

    def decide(d: Column) -> Column:
        n = F.size(d) + 1
        tail = F.slice(d, 2, F.greatest(F.size(d) - 1, F.lit(0)))
        centre, spread = A.mean(tail), p.uncertainty_alpha * A.std(tail)
        high = F.round(centre + spread, 12)
        low = F.round(F.greatest(F.lit(0.0), centre - spread), 12)
        bonus = F.when((F.size(tail) > 0) & (at(d, 1) > high), 1).otherwise(0)
        for place in (2, 3):
            bonus = bonus + F.when(at(d, place) < low, 1).otherwise(0)
        return clamp(F.least(F.lit(p.min_clips), n) + bonus, n, 1, p.max_clips)

    return F.when(F.size(curve) <= 0, F.lit(0)).otherwise(let(drops, decide))


def entropy_hazard(curve: Column, p: DepthParams) -> Column:
    """Stop hazard from suffix entropies; depth is a quantile of the stop distribution."""

    def pick(v: Column, n: Column) -> Column:
        def hazards(gaps: Column) -> Column:
            def hazard(i: Column) -> Column:
                def body(s: Column) -> Column:
                    m = F.size(s)
                    mass = A.total(s)
                    entropy = let(
                        mass,
                        lambda t: F.when((m <= 1) | (t <= 1e-12), F.lit(1.0)).otherwise(
                            F.least(
                                F.lit(1.0),
                                F.greatest(
                                    F.lit(0.0),
                                    -A.total(
                                        F.transform(
                                            s,
                                            lambda g: (g / t)
                                            * F.log(F.greatest(g / t, F.lit(1e-12))),
                                        )
                                    )
                                    / F.log(m.cast("double")),
                                ),
                            )
                        ),
                    )
                    heat = F.greatest(
                        F.lit(1e-12), mass * F.sqrt(F.greatest(entropy, F.lit(1e-12)))
                    )

                    def posterior(b: Column) -> Column:
                        logits = F.transform(s, lambda g: (g - b["mid"]) / b["heat"])

                        def stop(l: Column) -> Column:
                            peak = F.greatest(F.array_max(l), F.lit(0.0))
                            weight = A.total(F.transform(l, lambda x: F.exp(x - peak)))
                            return F.exp(F.get(l, F.lit(0)) - peak) / (weight + F.exp(-peak))

                        return let(logits, stop)

                    return let(
                        F.struct(A.median(s).alias("mid"), heat.alias("heat")), posterior
                    )

                return let(F.slice(gaps, i, F.size(gaps) - i + 1), body)

            return F.transform(A.positions(1, F.size(gaps)), hazard)

        def depth(h: Column) -> Column:
            # P(K <= k) = 1 - product of the continue probabilities up to k
            through = F.transform(
                A.positions(1, F.size(h)),
                lambda k: 1.0
                - F.aggregate(F.slice(h, 1, k), F.lit(1.0), lambda acc, x: acc * (1.0 - x)),
            )
            crossed = let(
                through, lambda c: A.first_index(c, lambda x: F.round(x, 12) >= p.hazard_quantile)
            )
            return F.coalesce(crossed, n)

        return let(let(A.adjacent_drops(v), hazards), depth)

    return _scaled_policy(curve, p, pick)


def _continue_probabilities(gaps: Column, p: DepthParams, use_mean: bool) -> Column:
    """Logistic probability of reading past each gap."""
    centre = A.mean(gaps) if use_mean else A.quantile(gaps, p.gap_quantile)

    def shape(c: Column) -> Column:
        spread = A.std(gaps) if use_mean else A.robust_spread(gaps, c)
        heat = F.greatest(
            F.lit(0.05), p.uncertainty_alpha * F.greatest(spread, F.lit(1e-8))
        )
        return let(
            heat, lambda t: F.transform(gaps, lambda g: 1.0 / (1.0 + F.exp((g - c) / t)))
        )

    return let(centre, shape)


def _soft_depth(curve: Column, p: DepthParams, kind: str) -> Column:
    """Unclamped soft-adjacent depth."""
    source = head(curve, p)
    values = let(A.running_min(source), lambda s: A.scaled(s))

    def depth(probs: Column) -> Column:
        if kind == "survival":
            terms = F.transform(
                A.positions(1, F.size(probs)),
                lambda i: F.power(
                    F.aggregate(F.slice(probs, 1, i), F.lit(1.0), lambda acc, x: acc * x),
                    F.lit(min(1.0, max(0.01, p.survival_gamma))),
                ),
            )
            return _half_up(1.0 + A.total(terms))
        if kind == "poibinomial":
            return _poisson_binomial_depth(probs, p)
        expected = 1.0 + A.total(probs)
        return F.floor(F.round(expected, 9)) if kind == "compact" else _half_up(expected)

    gaps = let(values, A.adjacent_drops)
    body = let(
        gaps,
        lambda g: F.when(F.size(g) == 0, F.size(source)).otherwise(
            let(_continue_probabilities(g, p, kind == "mean"), depth)
        ),
    )
    return body.cast("int")


def _poisson_binomial_depth(probs: Column, p: DepthParams) -> Column:
    start = F.array(F.lit(1.0))
    masses = F.aggregate(
        probs,
        start,
        lambda acc, q: F.transform(
            A.positions(1, F.size(acc) + 1),
            lambda i: F.coalesce(at(acc, i), F.lit(0.0)) * (1.0 - q)
            + F.coalesce(at(acc, i - 1), F.lit(0.0)) * q,
        ),
    )

    def decide(m: Column) -> Column:
        if p.decision == "map":
            return let(F.transform(m, lambda x: F.round(x, 12)), A.best_index)
        if p.decision == "quantile":
            return F.least(_mass_crossing(m, p.hazard_quantile), F.size(m))
        expected = 1.0 + A.total(F.transform(A.positions(1, F.size(m)), lambda i: (i - 1) * F.get(m, i - 1)))
        return F.ceil(F.round(expected, 9)) if p.decision == "ceil_mean" else _half_up(expected)

    return let(masses, decide)


def soft_adjacent(curve: Column, p: DepthParams, kind: str = "median") -> Column:
    """``kind``: median, mean, compact, survival or poibinomial."""
    n = F.size(head(curve, p))
    return clamp(_soft_depth(curve, p, kind), n, p.min_clips, p.max_clips)


def _drop_tail(start: Column, floor: Column, weak: Callable[[Column], Column], n: Column) -> Column:
    """Walk back from ``start`` while the last kept rank is weak and above ``floor``."""
    ranks = F.reverse(A.positions(1, n))
    return F.aggregate(
        ranks,
        F.struct(start.cast("int").alias("k"), F.lit(False).alias("done")),
        lambda acc, r: F.when(acc["done"] | (r > acc["k"]), acc).otherwise(
            F.when(
                (r == acc["k"]) & (r >= floor) & weak(r),
                F.struct((r - 1).alias("k"), F.lit(False).alias("done")),
            ).otherwise(F.struct(acc["k"].alias("k"), F.lit(True).alias("done")))
        ),
        lambda acc: acc["k"],
    )


def quality_gate(
    curve: Column, relevance: Column, redundancy: Column, p: DepthParams, compact: bool = False
) -> Column:
    """Soft-adjacent depth, then drop weak tail items."""
    g, rel, red = head(curve, p), head(relevance, p), head(redundancy, p)
    n = F.size(g)
    limits = F.struct(
        A.median(rel).alias("rel"),
        A.median(red).alias("red"),
        let(A.median(g), lambda m: m - p.gate_alpha * A.robust_spread(g, m)).alias("floor"),
    )

    def walk(b: Column) -> Column:
        def weak(r: Column) -> Column:
            score = F.round(F.get(g, r - 1), 12) < F.round(b["floor"], 12)
            return score | ((F.get(rel, r - 1) < b["rel"]) & (F.get(red, r - 1) > b["red"]))

        start = _soft_depth(curve, p, "compact" if compact else "median")
        lowest = F.lit(max(p.min_clips + 1, p.gate_min_rank))
        return _drop_tail(start, lowest, weak, n)

    return clamp(let(limits, walk), n, p.min_clips, p.max_clips)


def tail_gate(curve: Column, relevance: Column, p: DepthParams) -> Column:
    """Soft-adjacent depth, then drop tail items behind a large saturation gap."""
    g, rel = head(curve, p), head(relevance, p)
    n = F.size(g)
    gaps = let(let(A.running_min(g), lambda s: A.scaled(s)), A.adjacent_drops)

    def walk(d: Column) -> Column:
        edge = let(A.median(d), lambda m: m + p.tail_alpha * A.robust_spread(d, m))

        def weak(r: Column) -> Column:
            jump = F.round(F.coalesce(at(d, r - 1), F.lit(0.0)), 12) > F.round(edge, 12)
            quiet = F.get(rel, r - 1) <= A.median(F.slice(rel, 1, r - 1))
            low = F.get(g, r - 1) <= A.median(F.slice(g, 1, r))
            return jump & quiet & low

        keep = max(p.min_clips, p.tail_min_keep)
        return _drop_tail(
            _soft_depth(curve, p, "median"), F.lit(max(keep + 1, p.tail_min_rank)), weak, n
        )

    return clamp(let(gaps, walk), n, p.min_clips, p.max_clips)


def gain_extend(curve: Column, p: DepthParams) -> Column:
    """Soft-adjacent depth, extended by at most ``max_extra`` strong items."""
    g = head(curve, p)
    n = F.size(g)

    def extend(k: Column) -> Column:
        rest = F.slice(g, k + 1, p.max_extra)
        stop = A.first_index(rest, lambda x: x < p.stop_threshold)
        return k + F.coalesce(stop - 1, F.size(rest))

    return clamp(let(_soft_depth(curve, p, "median"), extend), n, p.min_clips, p.max_clips)


def robust_gap_boundary(curve: Column, p: DepthParams, plateau: bool = False) -> Column:
    """Stop at the first gap above the robust boundary once the minimum is reached."""
    alpha = p.plateau_alpha if plateau else p.uncertainty_alpha

    def pick(v: Column, n: Column) -> Column:
        def scan(d: Column) -> Column:
            edge = let(A.median(d), lambda m: F.round(m + alpha * A.robust_spread(d, m), 12))
            hit = let(
                edge,
                lambda e: F.get(
                    F.filter(
                        A.positions(max(1, p.min_clips), F.size(d)),
                        lambda k: F.round(F.get(d, k - 1), 12) > e,
                    ),
                    F.lit(0),
                ),
            )
            return F.coalesce(hit, n)

        return let(A.adjacent_drops(v), scan)

    return _scaled_policy(curve, p, pick)


def robust_z_boundary(curve: Column, p: DepthParams) -> Column:
    """Expected depth under Gaussian-CDF boundary weights."""
    values = let(A.running_min(head(curve, p)), lambda s: A.scaled(s))

    def decide(v: Column) -> Column:
        n = F.size(v)
        top = F.least(F.lit(p.max_clips), n)

        def weigh(d: Column) -> Column:
            shape = F.struct(
                A.median(d).alias("mid"),
                F.greatest(F.lit(0.05), let(A.median(d), lambda m: A.robust_spread(d, m))).alias("spread"),
            )

            def terms(b: Column) -> Column:
                weights = F.transform(
                    A.positions(p.min_clips, top),
                    lambda k: F.struct(
                        k.cast("double").alias("k"),
                        F.greatest(
                            F.lit(1e-6),
                            F.when(
                                (k < top) & (k <= F.size(d)),
                                0.5 * (1.0 + A.erf((F.get(d, k - 1) - b["mid"]) / b["spread"] / 2.0**0.5)),
                            ).otherwise(F.lit(0.5)),
                        ).alias("w"),
                    ),
                )
                return let(
                    weights,
                    lambda w: A.total(F.transform(w, lambda x: x["k"] * x["w"]))
                    / F.greatest(A.total(F.transform(w, lambda x: x["w"])), F.lit(1e-8)),
                )

            return _half_up(let(shape, terms))

        picked = F.when(n <= 1, n).otherwise(let(A.adjacent_drops(v), weigh))
        return clamp(picked, n, 1, p.max_clips)

    return let(values, decide)


def _relative_policy(curve: Column, p: DepthParams, pick: Callable[[Column, Column], Column]) -> Column:
    """Policies on relative drops of the smoothed curve, clamped from one upwards."""
    drops = let(
        A.running_min(head(curve, p)),
        lambda s: F.transform(A.relative_drops(s), lambda x: F.round(x, 12)),
    )

    def decide(d: Column) -> Column:
        n = F.size(d) + 1
        return clamp(pick(d, n), n, 1, p.max_clips)

    return F.when(F.size(curve) <= 0, F.lit(0)).otherwise(let(drops, decide))


def adaptive_gap(curve: Column, p: DepthParams) -> Column:
    """Extend from the minimum while the next relative drop stays small."""

    def pick(d: Column, n: Column) -> Column:
        start = F.least(F.lit(p.min_clips), n)
        close = F.round(
            F.greatest(F.lit(0.0), A.mean(d) - p.uncertainty_alpha * A.std(d)), 12
        )

        def extend(limit: Column) -> Column:
            stop = F.get(
                F.filter(A.positions(start, F.size(d)), lambda k: F.get(d, k - 1) > limit), F.lit(0)
            )
            return F.coalesce(stop, n)

        return let(close, extend)

    return _relative_policy(curve, p, pick)


def knee(curve: Column, p: DepthParams, adaptive: bool = False) -> Column:
    """Largest relative drop from the minimum on, if it is large enough; else everything."""

    def pick(d: Column, n: Column) -> Column:
        start = F.least(F.lit(p.min_clips), n)
        searched = F.slice(d, start, F.greatest(F.size(d) - start + 1, F.lit(0)))

        def choose(q: Column) -> Column:
            top = F.coalesce(F.array_max(q), F.lit(0.0))
            if adaptive:
                centre = F.round(A.mean(q), 12)
                edge = F.round(A.mean(q) + p.knee_alpha * A.std(q), 12)
                found = (F.size(q) > 0) & (top >= edge) & (top > centre)
            else:
                found = (F.size(q) > 0) & (top >= p.knee_min_drop)
            return F.when(found, A.best_index(q) + start - 1).otherwise(n)

        return let(searched, choose)

    return _relative_policy(curve, p, pick)


def fixed_uncertainty(curve: Column, p: DepthParams) -> Column:
    """Bonus clips by fixed thresholds on the second score and the next two gaps."""
    g = head(curve, p)
    n = F.size(g)
    bonus = F.when(at(g, 2) < p.confidence_threshold, 1).otherwise(0)
    for place in (2, 3):
        gap = F.round((at(g, place) - at(g, place + 1)) / (F.abs(at(g, place)) + 1e-6), 12)
        bonus = bonus + F.when(gap < p.ambiguity_gap, 1).otherwise(0)
    return clamp(F.least(F.lit(p.min_clips), n) + bonus, n, 1, p.max_clips)


def threshold(curve: Column, p: DepthParams) -> Column:
    """Keep going until the score falls below the threshold, never below the minimum."""
    g = head(curve, p)
    stop = F.get(
        F.filter(
            A.positions(max(1, p.min_clips) + 1, F.size(g)),
            lambda k: F.get(g, k - 1) < p.stop_threshold,
        ),
        F.lit(0),
    )
    return F.coalesce(stop - 1, F.size(g)).cast("int")


#: Policy names that need only the score curve, grouped with their accepted aliases.
POLICIES: dict[str, Callable[[Column, DepthParams], Column]] = {}


def _register(names: str, build: Callable[[Column, DepthParams], Column]) -> None:
    for name in names.split():
        POLICIES[name] = build


_register("raw_mmr_delta_root raw_mmr_delta_root_g1", lambda c, p: host_depth(c, p, True))
_register(
    "raw_mmr_delta_root_legacy raw_delta_root mmr_delta_root adjacent_delta_root",
    lambda c, p: host_depth(c, p, False),
)
_register("bic_boundary boundary_bic adaptive_boundary", bic_boundary)
_register("largest_gap_cut adaptive_largest_gap", largest_gap_cut)
_register("two_segment_change two_segment_changepoint", two_segment_change)
_register("budgeted_utility budgeted_marginal_utility", budgeted_utility)
_register("utility_mass evidence_utility_mass", utility_mass)
_register("softmax_mass evidence_mass", softmax_mass)
_register(
    "rag_adaptive_k_raw rag_adaptive_k_largest_gap_raw official_adaptive_k_largest_gap",
    lambda c, p: adaptive_k_raw(c, p, "largest_gap"),
)
_register(
    "rag_adaptive_k_moving_avg_raw official_adaptive_k_moving_avg",
    lambda c, p: adaptive_k_raw(c, p, "moving_avg"),
)
_register(
    "rag_adaptive_k_2diff_raw official_adaptive_k_2diff_spike",
    lambda c, p: adaptive_k_raw(c, p, "2diff_spike"),
)
_register("adaptive_k_scaled", adaptive_k_scaled)
_register(
    "relative_retention_survival adaptive_relative_retention retention_lengthnorm", retention_survival
)
_register(
    "relative_retention_expected adaptive_relative_retention_expected retention_expected",
    retention_expected,
)
_register(
    "relative_retention_ln_expectation adaptive_relative_retention_ln_expectation retention_ln_expectation",
    retention_ln_expectation,
)
_register("adaptive_uncertainty self_adaptive_uncertainty drop_uncertainty", adaptive_uncertainty)
_register("entropy_hazard_survival adaptive_entropy_hazard entropy_boundary_survival", entropy_hazard)
_register("soft_adjacent_uncertainty adaptive_soft_uncertainty soft_gap_uncertainty", soft_adjacent)
_register(
    "soft_adjacent_uncertainty_mean adaptive_soft_uncertainty_mean",
    lambda c, p: soft_adjacent(c, p, "mean"),
)
_register(
    "soft_adjacent_survival adaptive_soft_survival survival_soft_adjacent",
    lambda c, p: soft_adjacent(c, p, "survival"),
)
_register(
    "soft_adjacent_poibinomial adaptive_soft_poibinomial poibinomial_adjacent",
    lambda c, p: soft_adjacent(c, p, "poibinomial"),
)
_register("soft_adjacent_gain_extend adaptive_soft_gain_extend", gain_extend)
_register("prefix_plateau adaptive_prefix_plateau", lambda c, p: robust_gap_boundary(c, p, True))
_register("robust_gap_boundary adaptive_robust_gap mad_gap_boundary", robust_gap_boundary)
_register("robust_z_boundary_posterior adaptive_robust_z_boundary", robust_z_boundary)
_register("adaptive_gap_uncertainty self_adaptive_gap adjacent_gap_uncertainty", adaptive_gap)
_register("knee elbow saturation_knee", knee)
_register("adaptive_knee self_adaptive_knee", lambda c, p: knee(c, p, True))
_register("uncertainty confidence uncertainty_gap", fixed_uncertainty)
_register("threshold", threshold)

#: Policies that also read the relevance and redundancy of every step.
TRACE_POLICIES: dict[str, Callable[[Column, Column, Column, DepthParams], Column]] = {
    "soft_adjacent_quality_gate": lambda c, r, d, p: quality_gate(c, r, d, p),
    "adaptive_soft_quality_gate": lambda c, r, d, p: quality_gate(c, r, d, p),
    "compact_soft_adjacent": lambda c, r, d, p: quality_gate(c, r, d, p, compact=True),
    "soft_adjacent_tail_gate": lambda c, r, d, p: tail_gate(c, r, p),
    "adaptive_soft_tail_gate": lambda c, r, d, p: tail_gate(c, r, p),
}


def policy(
    name: str,
    curve: Column,
    params: DepthParams | None = None,
    relevance: Column | None = None,
    redundancy: Column | None = None,
) -> Column:
    """Depth column for a named policy; unknown names fall back to the threshold rule."""
    p = params or DepthParams()
    key = name.lower()
    if key in TRACE_POLICIES:
        return TRACE_POLICIES[key](curve, relevance, redundancy, p)
    return POLICIES.get(key, threshold)(curve, p)


def by_question_type(types: Column, switched: list[str], special: Column, default: Column) -> Column:
    """Use ``special`` when the question has one of the ``switched`` types."""
    wanted = F.array(*[F.lit(t) for t in switched])
    return F.when(F.arrays_overlap(F.coalesce(types, F.array().cast("array<string>")), wanted), special).otherwise(
        default
    )
