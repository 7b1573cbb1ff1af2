"""Depth policies on two kinds of score curves.

``daily``: per user, the value of each day in descending order of activity (a noisy, not
monotone curve). ``trace``: the greedy marginal scores of each label's pool.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.catalog.registry import big, query, table
from cliptide.catalog.selection import scored_vectors
from cliptide.catalog.sqlparts import SCORED, mmr_ctes
from cliptide.operators import depth, mmr, scoring
from cliptide.operators.depth import DepthParams


def daily_curves(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user; days are few, so the event rows are summed map-side first."""
    days = (
        table(spark, folder, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / 1000.0, 6).alias("g"),
        )
    )
    step = F.struct((-F.col("n")).alias("order"), "day", "g")
    packed = days.groupBy("user_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return packed.select("user_id", F.col("steps.g").alias("curve"))


DAILY = """
daily AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n,
                 round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / 1000.0, 6) AS g
          FROM events GROUP BY 1, 2),
whole AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, day) AS k, g FROM daily)
"""


def head_sql(limit: int | None, smooth: bool = True, floor: float = 1e-6) -> str:
    """``pts(id, k, g, s, z, n)``: raw, smoothed and scaled curve values up to ``limit``."""
    cut = "" if limit is None else f"WHERE k <= {limit}"
    return f"""{DAILY},
cutp AS (SELECT * FROM whole {cut}),
smp AS (SELECT id, k, g, min(g) OVER (PARTITION BY id ORDER BY k) AS s, count(*) OVER (PARTITION BY id) AS n FROM cutp),
pts AS (SELECT id, k, g, s, n, (s - min(s) OVER (PARTITION BY id)) /
        greatest(max(s) OVER (PARTITION BY id) - min(s) OVER (PARTITION BY id), {floor}) AS z FROM smp),
gaps AS (SELECT id, k, n, greatest(0.0, z - nz) AS gap FROM
         (SELECT *, lead(z) OVER (PARTITION BY id ORDER BY k) AS nz FROM pts) WHERE nz IS NOT NULL),
rel AS (SELECT id, k, n, round(greatest(0.0, s - ns) / greatest(abs(s), 1e-6), 12) AS d FROM
        (SELECT *, lead(s) OVER (PARTITION BY id ORDER BY k) AS ns FROM pts) WHERE ns IS NOT NULL)
"""


def finish(pick: str, low: int, high: int) -> str:
    """Clamp ``picked(id, c)``; a missing or single-item pick keeps everything."""
    return f"""{pick}
SELECT CAST(m.id AS BIGINT) AS user_id, CAST(greatest(least(greatest(1, {low}), least({high}, m.n)),
       least(least({high}, m.n), CASE WHEN m.n <= 1 THEN m.n ELSE coalesce(p.c, m.n) END)) AS BIGINT) AS k
FROM (SELECT DISTINCT id, n FROM pts) m LEFT JOIN picked p ON p.id = m.id"""


def add(name: str, policy: str, params: DepthParams, sql: str) -> None:
    def build(spark: SparkSession, folder: str) -> DataFrame:
        curves = daily_curves(spark, folder)
        k = depth.policy(policy, F.col("curve"), params)
        return curves.select(big("user_id"), k.cast("bigint").alias("k"))

    query(name, sql)(build)


P = DepthParams()
H = head_sql(5)
FULL = head_sql(None)
WIDE = DepthParams(max_clips=20)

add(
    "depth_largest_gap",
    "largest_gap_cut",
    P,
    finish(f"WITH {H}, picked AS (SELECT id, arg_max(k, (gap, -k)) AS c FROM gaps GROUP BY id)", 2, 5),
)

_SPLITS = """
splits AS (SELECT a.id, a.k, a.n,
  (SELECT sum(p.{y} * p.{y}) - sum(p.{y}) * sum(p.{y}) / count(*) FROM pts p WHERE p.id = a.id AND p.k <= a.k)
  + (SELECT sum(p.{y} * p.{y}) - sum(p.{y}) * sum(p.{y}) / count(*) FROM pts p WHERE p.id = a.id AND p.k > a.k) AS sse
  FROM pts a WHERE a.k >= 2 AND a.k < a.n)
"""
add(
    "depth_two_segment",
    "two_segment_change",
    P,
    finish(
        f"WITH {H}, {_SPLITS.format(y='z')}, picked AS (SELECT m.id, coalesce(arg_min(k, (round(sse, 12), k)), 2) AS c "
        "FROM (SELECT DISTINCT id FROM pts) m LEFT JOIN splits s USING (id) GROUP BY m.id)",
        2,
        5,
    ),
)
add(
    "depth_bic",
    "bic_boundary",
    P,
    finish(
        f"""WITH {H}, {_SPLITS.format(y='s')},
lin AS (SELECT id, max(n) AS n, round(max(n) * ln(greatest(regr_syy(s, k) - CASE WHEN regr_sxx(s, k) > 0 THEN
        regr_sxy(s, k) * regr_sxy(s, k) / regr_sxx(s, k) ELSE 0 END, 0) / max(n) + 1e-8) + 2 * ln(max(n)), 9) AS b
        FROM pts GROUP BY id),
opts AS (SELECT id, n AS k, b, 0 AS pri FROM lin UNION ALL
         SELECT id, k, round(n * ln(greatest(sse, 0) / n + 1e-8) + 3 * ln(n), 9), 1 FROM splits),
picked AS (SELECT id, arg_min(k, (b, pri, k)) AS c FROM opts GROUP BY id)""",
        1,
        5,
    ),
)
add(
    "depth_budgeted_utility",
    "budgeted_utility",
    P,
    finish(
        f"""WITH {H}, lim AS (SELECT id, round(avg(z), 12) AS f, max(n) AS n FROM pts GROUP BY id),
picked AS (SELECT l.id, coalesce(min(p.k) - 1, max(l.n)) AS c FROM lim l
           LEFT JOIN pts p ON p.id = l.id AND p.k > 2 AND round(p.z, 12) < l.f GROUP BY l.id)""",
        2,
        5,
    ),
)
_MASS = """w AS ({weights}),
cum AS (SELECT id, k, round(sum(w) OVER (PARTITION BY id ORDER BY k), 12) AS c FROM w),
picked AS (SELECT id, min(k) AS c FROM cum WHERE c >= 0.8 GROUP BY id)"""
add(
    "depth_utility_mass",
    "utility_mass",
    P,
    finish(
        f"WITH {H}, "
        + _MASS.format(
            weights="SELECT id, k, CASE WHEN sum(z) OVER (PARTITION BY id) <= 1e-12 THEN 1.0 / n "
            "ELSE z / sum(z) OVER (PARTITION BY id) END AS w FROM pts"
        ),
        2,
        5,
    ),
)
add(
    "depth_softmax_mass",
    "softmax_mass",
    P,
    finish(
        f"""WITH {H}, med AS (SELECT id, median(z) AS m FROM pts GROUP BY id),
temp AS (SELECT id, greatest(0.1, 1.4826 * median(abs(z - m))) AS t, max(z) AS top FROM pts JOIN med USING (id) GROUP BY id),
ex AS (SELECT id, k, exp((z - top) / t) AS e FROM pts JOIN temp USING (id)), """
        + _MASS.format(weights="SELECT id, k, e / sum(e) OVER (PARTITION BY id) AS w FROM ex"),
        2,
        5,
    ),
)

#: The relevance curve sorted downwards, as adaptive-k reads it.
SORTED = f"""{DAILY},
srt AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY g DESC) AS k, g, count(*) OVER (PARTITION BY id) AS n FROM whole),
pts AS (SELECT id, k, g, n FROM srt),
fall AS (SELECT id, k, n, round(g - ng, 12) AS f FROM (SELECT *, lead(g) OVER (PARTITION BY id ORDER BY k) AS ng FROM srt)
         WHERE ng IS NOT NULL),
largest AS (SELECT id, arg_max(k, (f, -k)) AS c FROM fall GROUP BY id)
"""
add(
    "adaptive_k_gap",
    "rag_adaptive_k_largest_gap_raw",
    WIDE,
    finish(f"WITH {SORTED}, picked AS (SELECT * FROM largest)", 2, 20),
)
add(
    "adaptive_k_moving_avg",
    "rag_adaptive_k_moving_avg_raw",
    WIDE,
    finish(
        f"""WITH {SORTED},
ma AS (SELECT id, k, n, avg(g) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a,
       count(*) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS cnt FROM srt),
mf AS (SELECT id, k, round(a - lead(a) OVER (PARTITION BY id ORDER BY k), 12) AS f FROM ma WHERE cnt = 3),
mb AS (SELECT id, arg_max(k, (f, -k)) AS c FROM mf WHERE f IS NOT NULL GROUP BY id),
picked AS (SELECT l.id, coalesce(m.c, l.c) AS c FROM largest l LEFT JOIN mb m USING (id))""",
        2,
        20,
    ),
)
add(
    "adaptive_k_2diff",
    "rag_adaptive_k_2diff_raw",
    WIDE,
    finish(
        f"""WITH {SORTED},
d2 AS (SELECT id, k, n, round(nd - d, 12) AS b FROM (SELECT id, k, n, d, lead(d) OVER (PARTITION BY id ORDER BY k) AS nd FROM
       (SELECT id, k, n, lead(g) OVER (PARTITION BY id ORDER BY k) - g AS d FROM srt) WHERE d IS NOT NULL) WHERE nd IS NOT NULL),
sp AS (SELECT id, min(k) AS c FROM (SELECT *, min(b) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING
       AND 1 PRECEDING) AS lo FROM d2) WHERE n > 3 AND b > 0 AND lo < 0 GROUP BY id),
picked AS (SELECT l.id, coalesce(s.c + 1, l.c) AS c FROM largest l LEFT JOIN sp s USING (id))""",
        2,
        20,
    ),
)
add(
    "adaptive_k_scaled",
    "adaptive_k_scaled",
    DepthParams(max_clips=8, retrieve_more=2),
    finish(
        f"WITH {head_sql(None, floor=1e-12)}, picked AS (SELECT id, arg_max(k, (gap, -k)) + 2 AS c FROM gaps GROUP BY id)",
        2,
        8,
    ),
)

_RETAIN = f"""WITH {FULL},
pr AS (SELECT id, k, n, z, least(1.0, greatest(0.0, nz / greatest(abs(z), 1e-12))) AS p FROM
       (SELECT *, lead(z) OVER (PARTITION BY id ORDER BY k) AS nz FROM pts)),
lg AS (SELECT id, k, n, (coalesce(sum(ln(greatest(p, 1e-12))) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING
       AND 1 PRECEDING), 0) + CASE WHEN k < n THEN ln(greatest(1.0 - p, 1e-12)) ELSE 0 END) / k AS l FROM pr)"""
add(
    "depth_retention_survival",
    "relative_retention_survival",
    WIDE,
    finish(
        f"{_RETAIN}, picked AS (SELECT id, arg_max(k, (round(exp(l), 12), -k)) AS c FROM lg GROUP BY id)", 2, 20
    ),
)
add(
    "depth_retention_expected",
    "relative_retention_expected",
    WIDE,
    finish(
        f"WITH {FULL}, picked AS (SELECT id, floor(round(sum(z) / greatest(abs(max(z) FILTER (k = 1)), 1e-12), 9) + 0.5) AS c "
        "FROM pts GROUP BY id)",
        2,
        20,
    ),
)
add(
    "depth_retention_ln_expectation",
    "relative_retention_ln_expectation",
    WIDE,
    finish(
        f"{_RETAIN}, picked AS (SELECT id, ceil(round(sum(k * exp(l)) / greatest(sum(exp(l)), 1e-12), 9)) AS c FROM lg GROUP BY id)",
        2,
        20,
    ),
)
add(
    "depth_adaptive_uncertainty",
    "adaptive_uncertainty",
    P,
    finish(
        f"""WITH {H}, tail AS (SELECT id, avg(d) AS m, stddev_pop(d) AS sd FROM rel WHERE k >= 2 GROUP BY id),
picked AS (SELECT r.id, least(2, max(r.n)) + sum(CASE WHEN r.k = 1 AND t.m IS NOT NULL AND r.d > round(t.m + t.sd, 12) THEN 1
           WHEN r.k IN (2, 3) AND r.d < round(greatest(0.0, t.m - t.sd), 12) THEN 1 ELSE 0 END) AS c
           FROM rel r LEFT JOIN tail t USING (id) GROUP BY r.id)""",
        1,
        5,
    ),
)
add(
    "depth_entropy_hazard",
    "entropy_hazard_survival",
    P,
    finish(
        f"""WITH {H},
suf AS (SELECT a.id, a.k, b.k AS j, b.gap FROM gaps a JOIN gaps b ON b.id = a.id AND b.k >= a.k),
tot AS (SELECT id, k, sum(gap) AS t, count(*) AS m, median(gap) AS med FROM suf GROUP BY id, k),
ent AS (SELECT s.id, s.k, any_value(t) AS t, any_value(med) AS med, CASE WHEN any_value(m) <= 1 OR any_value(t) <= 1e-12 THEN 1.0
        ELSE least(1.0, greatest(0.0, -sum((gap / t) * ln(greatest(gap / t, 1e-12))) / ln(any_value(m)))) END AS h
        FROM suf s JOIN tot USING (id, k) GROUP BY s.id, s.k),
lgt AS (SELECT s.id, s.k, s.j, (s.gap - e.med) / greatest(1e-12, e.t * sqrt(greatest(e.h, 1e-12))) AS l
        FROM suf s JOIN ent e USING (id, k)),
pk AS (SELECT id, k, greatest(0.0, max(l)) AS top FROM lgt GROUP BY id, k),
hz AS (SELECT l.id, l.k, sum(exp(l.l - p.top)) FILTER (l.j = l.k) / (sum(exp(l.l - p.top)) + exp(-any_value(p.top))) AS h
       FROM lgt l JOIN pk p USING (id, k) GROUP BY l.id, l.k),
cdf AS (SELECT id, k, round(1.0 - product(1.0 - h) OVER (PARTITION BY id ORDER BY k), 12) AS c FROM hz),
picked AS (SELECT id, min(k) AS c FROM cdf WHERE c >= 0.6 GROUP BY id)""",
        2,
        5,
    ),
)

_SOFT = f"""WITH {H},
loc AS (SELECT id, {{loc}} AS c, stddev_pop(gap) AS sd FROM gaps GROUP BY id),
spr AS (SELECT id, any_value(c) AS c, any_value(sd) AS sd, 1.4826 * median(abs(gap - c)) AS mad FROM gaps JOIN loc USING (id) GROUP BY id),
tem AS (SELECT id, c, greatest(0.05, greatest({{spread}}, 1e-8)) AS t FROM spr),
prob AS (SELECT id, k, n, 1.0 / (1.0 + exp((gap - c) / t)) AS p FROM gaps JOIN tem USING (id))"""
_SOFT_MEDIAN = _SOFT.format(loc="median(gap)", spread="CASE WHEN mad <= 1e-8 THEN sd ELSE mad END")
_SOFT_MEAN = _SOFT.format(loc="avg(gap)", spread="sd")
_HALF = "floor(round(1.0 + sum({x}), 9) + 0.5)"
add(
    "depth_soft_adjacent",
    "soft_adjacent_uncertainty",
    P,
    finish(f"{_SOFT_MEDIAN}, picked AS (SELECT id, {_HALF.format(x='p')} AS c FROM prob GROUP BY id)", 2, 5),
)
add(
    "depth_soft_adjacent_mean",
    "soft_adjacent_uncertainty_mean",
    P,
    finish(f"{_SOFT_MEAN}, picked AS (SELECT id, {_HALF.format(x='p')} AS c FROM prob GROUP BY id)", 2, 5),
)
add(
    "depth_soft_survival",
    "soft_adjacent_survival",
    P,
    finish(
        f"{_SOFT_MEDIAN}, sv AS (SELECT id, product(p) OVER (PARTITION BY id ORDER BY k) AS s FROM prob), "
        f"picked AS (SELECT id, {_HALF.format(x='s')} AS c FROM sv GROUP BY id)",
        2,
        5,
    ),
)
add(
    "depth_poibinomial_quantile",
    "soft_adjacent_poibinomial",
    DepthParams(decision="quantile"),
    finish(
        f"""{_SOFT_MEDIAN},
coin AS (SELECT id, k, p FROM prob UNION ALL SELECT m.id, j.k, 0.0 FROM (SELECT DISTINCT id, n FROM prob) m, (SELECT unnest(range(1, 5)) AS k) j WHERE j.k >= m.n),
four AS (SELECT id, max(p) FILTER (k = 1) AS a, max(p) FILTER (k = 2) AS b, max(p) FILTER (k = 3) AS c, max(p) FILTER (k = 4) AS d,
         count(*) AS cnt FROM coin GROUP BY id),
outc AS (SELECT id, w + x + y + z AS cnt, (CASE WHEN w = 1 THEN a ELSE 1 - a END) * (CASE WHEN x = 1 THEN b ELSE 1 - b END)
         * (CASE WHEN y = 1 THEN c ELSE 1 - c END) * (CASE WHEN z = 1 THEN d ELSE 1 - d END) AS m
         FROM four, (VALUES (0), (1)) q1(w), (VALUES (0), (1)) q2(x), (VALUES (0), (1)) q3(y), (VALUES (0), (1)) q4(z)),
mass AS (SELECT id, cnt, sum(m) AS m FROM outc GROUP BY id, cnt),
cum AS (SELECT id, cnt, round(sum(m) OVER (PARTITION BY id ORDER BY cnt), 12) AS c FROM mass),
picked AS (SELECT id, 1 + min(cnt) AS c FROM cum WHERE c >= 0.6 GROUP BY id)""",
        2,
        5,
    ),
)
add(
    "depth_gain_extend",
    "soft_adjacent_gain_extend",
    DepthParams(max_clips=9, stop_threshold=0.3),
    finish(
        _SOFT_MEDIAN.replace(H, head_sql(9))
        + f""", base AS (SELECT id, {_HALF.format(x='p')} AS b FROM prob GROUP BY id),
ext AS (SELECT b.id, b.b, min(p.k) AS stop FROM base b LEFT JOIN pts p ON p.id = b.id AND p.k > b.b AND p.k <= b.b + 2 AND p.g < 0.3
        GROUP BY b.id, b.b),
picked AS (SELECT id, coalesce(stop - 1, b + 2) AS c FROM ext)""",
        2,
        9,
    ),
)

_ROBUST = """
gm AS (SELECT id, median(gap) AS m, stddev_pop(gap) AS sd FROM gaps GROUP BY id),
gs AS (SELECT id, any_value(m) AS m, CASE WHEN 1.4826 * median(abs(gap - m)) <= 1e-8 THEN any_value(sd)
       ELSE 1.4826 * median(abs(gap - m)) END AS sp FROM gaps JOIN gm USING (id) GROUP BY id)"""
for _name, _policy, _alpha in (
    ("depth_prefix_plateau", "prefix_plateau", 0.0),
    ("depth_robust_gap", "robust_gap_boundary", 1.0),
):
    add(
        _name,
        _policy,
        P,
        finish(
            f"WITH {H}, {_ROBUST}, picked AS (SELECT g.id, min(g.k) AS c FROM gaps g JOIN gs s USING (id) "
            f"WHERE g.k >= 2 AND round(g.gap, 12) > round(s.m + {_alpha} * s.sp, 12) GROUP BY g.id)",
            2,
            5,
        ),
    )
add(
    "depth_robust_z",
    "robust_z_boundary_posterior",
    P,
    finish(
        f"""WITH {H}, {_ROBUST},
zz AS (SELECT m.id, j.k, CASE WHEN j.k < m.n THEN (g.gap - s.m) / greatest(0.05, s.sp) / sqrt(2.0) END AS x
       FROM (SELECT DISTINCT id, n FROM pts WHERE n > 1) m JOIN (SELECT unnest(range(2, 6)) AS k) j ON j.k <= m.n
       JOIN gs s ON s.id = m.id LEFT JOIN gaps g ON g.id = m.id AND g.k = j.k),
ser AS (SELECT id, k, x, CASE WHEN x IS NULL THEN 0.0 WHEN abs(x) >= 5 THEN sign(x) ELSE sign(x) * exp(-x * x) * 1.1283791670955126 *
        list_sum(list_transform(range(0, 121), lambda i: exp((2 * i + 1) * ln(greatest(abs(x), 1e-300)) + 2 * i * ln(2.0) + lgamma(i + 1.0)
                 - lgamma(2.0 * i + 2.0)))) END AS e FROM zz),
picked AS (SELECT id, floor(round(sum(k * greatest(1e-6, 0.5 * (1 + e))) / sum(greatest(1e-6, 0.5 * (1 + e))), 9) + 0.5) AS c
           FROM ser GROUP BY id)""",
        1,
        5,
    ),
)
add(
    "depth_adaptive_gap",
    "adaptive_gap_uncertainty",
    P,
    finish(
        f"""WITH {H}, lim AS (SELECT id, round(greatest(0.0, avg(d) - stddev_pop(d)), 12) AS f FROM rel GROUP BY id),
picked AS (SELECT r.id, min(r.k) AS c FROM rel r JOIN lim USING (id) WHERE r.k >= 2 AND r.d > f GROUP BY r.id)""",
        1,
        5,
    ),
)
add(
    "depth_knee",
    "knee",
    P,
    finish(
        f"WITH {H}, picked AS (SELECT id, arg_max(k, (d, -k)) AS c FROM rel WHERE k >= least(2, n) AND d >= 0.25 GROUP BY id)", 1, 5
    ),
)
add(
    "depth_adaptive_knee",
    "adaptive_knee",
    P,
    finish(
        f"""WITH {H}, lim AS (SELECT id, avg(d) AS m, stddev_pop(d) AS sd, max(d) AS top, arg_max(k, (d, -k)) AS best
FROM rel WHERE k >= least(2, n) GROUP BY id),
picked AS (SELECT id, best AS c FROM lim WHERE top >= round(m + sd, 12) AND top > round(m, 12))""",
        1,
        5,
    ),
)
add(
    "depth_fixed_uncertainty",
    "uncertainty",
    P,
    finish(
        f"""WITH {H}, nx AS (SELECT id, k, n, g, lead(g) OVER (PARTITION BY id ORDER BY k) AS ng FROM pts),
picked AS (SELECT id, least(2, max(n)) + sum(CASE WHEN k = 2 AND g < 0.3 THEN 1 ELSE 0 END) + sum(CASE WHEN k IN (2, 3)
           AND round((g - ng) / (abs(g) + 1e-6), 12) < 0.25 THEN 1 ELSE 0 END) AS c FROM nx GROUP BY id)""",
        1,
        5,
    ),
)
add(
    "depth_threshold",
    "threshold",
    DepthParams(stop_threshold=0.4),
    finish(
        f"WITH {H}, picked AS (SELECT id, min(k) - 1 AS c FROM pts WHERE k > 2 AND g < 0.4 GROUP BY id)", 1, 5
    ),
)


@query(
    "depth_delta_root_legacy",
    finish(
        f"""WITH {head_sql(6)}, r AS (SELECT id, k, pow(greatest(g - ng, 1e-12), 1.0 / k) AS s, greatest(g - ng, 1e-12) AS d FROM
(SELECT *, lead(g) OVER (PARTITION BY id ORDER BY k) AS ng FROM pts) WHERE ng IS NOT NULL AND k BETWEEN 2 AND 5),
picked AS (SELECT m.id, coalesce(arg_max(k, (s, d, -k)), least(2, any_value(m.n))) AS c
           FROM (SELECT DISTINCT id, n FROM pts) m LEFT JOIN r USING (id) GROUP BY m.id)""",
        2,
        5,
    ),
)
def delta_root_legacy(spark: SparkSession, folder: str) -> DataFrame:
    head = F.slice("curve", 1, 6)
    k = depth.host_depth(head, P, by_first=False)
    return daily_curves(spark, folder).select(big("user_id"), k.cast("bigint").alias("k"))


@query(
    "depth_host_variant",
    finish(
        f"""WITH {head_sql(6)}, r AS (SELECT id, k, (g - ng) / g1 AS d, pow((g - ng) / g1, 1.0 / k) AS s FROM
(SELECT *, lead(g) OVER (PARTITION BY id ORDER BY k) AS ng, first_value(g) OVER (PARTITION BY id ORDER BY k) AS g1 FROM pts)
WHERE ng IS NOT NULL AND k BETWEEN 2 AND 5 AND g > ng AND g1 > 0),
picked AS (SELECT m.id, coalesce(arg_max(k, (s, d, -k)), CASE WHEN least(5, any_value(m.n) - 1) >= 2 THEN 5 ELSE 2 END) AS c
           FROM (SELECT DISTINCT id, n FROM pts) m LEFT JOIN r USING (id) GROUP BY m.id)""",
        2,
        5,
    ),
)
def host_variant(spark: SparkSession, folder: str) -> DataFrame:
    k = depth.host_depth(F.slice("curve", 1, 6), P, by_first=True)
    return daily_curves(spark, folder).select(big("user_id"), k.cast("bigint").alias("k"))


@query(
    "calibrated_depth",
    f"""WITH {DAILY}, c9 AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, first_value(g) OVER (PARTITION BY id ORDER BY k) AS g1,
lead(g) OVER (PARTITION BY id ORDER BY k) AS ng FROM (SELECT * FROM whole WHERE k <= 9)),
r AS (SELECT id, k, (g - ng) / g1 AS d, pow((g - ng) / g1, 1.0 / k) AS s FROM c9 WHERE g1 > 0 AND ng IS NOT NULL AND g > ng
      AND k BETWEEN 2 AND 8),
b AS (SELECT id, arg_max(k, (s, d, -k)) AS k FROM r GROUP BY id)
SELECT CAST(c.id AS BIGINT) AS user_id, CAST(CASE WHEN b.k IS NULL THEN least(8, n) ELSE least(least(8, n), greatest(2, b.k)) END
  AS BIGINT) AS k, CASE WHEN b.k IS NOT NULL THEN 'calibrated_adjacent_drop' WHEN g1 <= 0 OR least(8, n - 1) < 2
  THEN 'no_valid_boundary_return_max' ELSE 'no_positive_drop_return_max' END AS reason
FROM c9 c LEFT JOIN b USING (id) WHERE c.k = 1""",
)
def calibrated(spark: SparkSession, folder: str) -> DataFrame:
    chosen = depth.calibrated_depth(F.slice("curve", 1, 9))
    rows = daily_curves(spark, folder).withColumn("chosen", chosen)
    return rows.select(
        big("user_id"), F.col("chosen.k").cast("bigint").alias("k"), F.col("chosen.reason").alias("reason")
    )


def label_curves(spark: SparkSession, folder: str) -> DataFrame:
    pool = scoring.candidate_pool(scored_vectors(spark, folder), ["label"], 200)
    trace = mmr.greedy_prefix(pool, ["label"], 8, 0.75, relevance_mode="minmax_one", tie="first")
    return mmr.curve(trace, ["label"])


GATE = DepthParams(max_clips=8, gate_alpha=0.3, tail_alpha=-0.5)
_LABELS = f"""WITH {SCORED}, {mmr_ctes(8, 0.75, scaling='minmax_one', tie_first=True)},
tr AS (SELECT label AS id, rank AS k, relevance AS r, redundancy AS q, marginal AS g, count(*) OVER (PARTITION BY label) AS n FROM trace),
smp AS (SELECT *, min(g) OVER (PARTITION BY id ORDER BY k) AS s FROM tr),
pts AS (SELECT *, (s - min(s) OVER (PARTITION BY id)) / greatest(max(s) OVER (PARTITION BY id) - min(s) OVER (PARTITION BY id), 1e-6) AS z FROM smp),
gaps AS (SELECT id, k, n, greatest(0.0, z - nz) AS gap FROM (SELECT *, lead(z) OVER (PARTITION BY id ORDER BY k) AS nz FROM pts) WHERE nz IS NOT NULL),
""" + _SOFT_MEDIAN.split(H + ",")[1]


def gate_sql(base: str, weak: str, lowest: int) -> str:
    """Depth after dropping the unbroken run of weak ranks ending at the base depth."""
    return f"""{_LABELS},
base AS (SELECT id, CAST({base} AS INT) AS b, any_value(n) AS n FROM prob GROUP BY id),
{weak},
stopk AS (SELECT b.id, b.b, max(w.k) AS keep FROM base b LEFT JOIN weak w ON w.id = b.id AND w.k <= b.b
          AND (NOT w.weak OR w.k < {lowest}) GROUP BY b.id, b.b)
SELECT CAST(s.id AS BIGINT) AS label, CAST(least(8, greatest(2, coalesce(s.keep, s.b))) AS BIGINT) AS k FROM stopk s"""


_QUALITY = """lim AS (SELECT id, median(g) AS gm, stddev_pop(g) AS sd, median(r) AS rm, median(q) AS qm FROM pts GROUP BY id),
lim2 AS (SELECT id, any_value(gm) AS gm, any_value(rm) AS rm, any_value(qm) AS qm, CASE WHEN 1.4826 * median(abs(g - gm)) <= 1e-8
         THEN any_value(sd) ELSE 1.4826 * median(abs(g - gm)) END AS sp FROM pts JOIN lim USING (id) GROUP BY id),
weak AS (SELECT p.id, p.k, round(p.g, 12) < round(gm - 0.3 * sp, 12) OR (p.r < rm AND p.q > qm) AS weak FROM pts p JOIN lim2 USING (id))"""
_TAIL = f"""{_ROBUST},
weak AS (SELECT a.id, a.k, coalesce(round(d.gap, 12) > round(any_value(s.m) - 0.5 * any_value(s.sp), 12), FALSE)
  AND a.r <= coalesce(median(b.r) FILTER (b.k < a.k), 0) AND a.g <= median(b.g) AS weak
  FROM pts a JOIN pts b ON b.id = a.id AND b.k <= a.k JOIN gs s ON s.id = a.id LEFT JOIN gaps d ON d.id = a.id AND d.k = a.k - 1
  GROUP BY a.id, a.k, a.r, a.g, d.gap)"""


def add_gate(name: str, policy: str, sql: str) -> None:
    def build(spark: SparkSession, folder: str) -> DataFrame:
        curves = label_curves(spark, folder)
        k = depth.policy(policy, F.col("curve"), GATE, F.col("steps.relevance"), F.col("steps.redundancy"))
        return curves.select(big("label"), k.cast("bigint").alias("k"))

    query(name, sql)(build)


add_gate("depth_quality_gate", "soft_adjacent_quality_gate", gate_sql(_HALF.format(x="p"), _QUALITY, 3))
add_gate("depth_compact_soft", "compact_soft_adjacent", gate_sql("floor(round(1.0 + sum(p), 9))", _QUALITY, 3))
add_gate("depth_tail_gate", "soft_adjacent_tail_gate", gate_sql(_HALF.format(x="p"), _TAIL, 3))


@query(
    "depth_type_switch",
    f"""WITH {head_sql(5)}, kinds AS (SELECT user_id, max(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) AS hit
FROM events GROUP BY user_id),
a AS (SELECT id, min(k) - 1 AS c FROM pts WHERE k > 2 AND g < 0.4 GROUP BY id),
b AS (SELECT id, arg_max(k, (gap, -k)) AS c FROM gaps GROUP BY id),
picked AS (SELECT m.id, CASE WHEN hit = 1 THEN coalesce(b.c, m.n) ELSE coalesce(a.c, m.n) END AS c, hit FROM (SELECT DISTINCT id, n FROM pts) m
  JOIN kinds ON kinds.user_id = m.id LEFT JOIN a ON a.id = m.id LEFT JOIN b ON b.id = m.id)
SELECT CAST(m.id AS BIGINT) AS user_id, CAST(CASE WHEN m.n <= 1 THEN m.n WHEN p.hit = 1 THEN greatest(least(2, m.n), least(least(5, m.n), p.c))
  ELSE p.c END AS BIGINT) AS k FROM (SELECT DISTINCT id, n FROM pts) m JOIN picked p USING (id)""",
)
def type_switch(spark: SparkSession, folder: str) -> DataFrame:
    kinds = (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(F.collect_set("event_type").alias("types"))
    )
    curves = daily_curves(spark, folder).join(kinds, "user_id")
    k = depth.by_question_type(
        F.col("types"),
        ["purchase", "signup"],
        depth.policy("largest_gap_cut", F.col("curve"), P),
        depth.policy("threshold", F.col("curve"), DepthParams(stop_threshold=0.4)),
    )
    return curves.select(big("user_id"), k.cast("bigint").alias("k"))
