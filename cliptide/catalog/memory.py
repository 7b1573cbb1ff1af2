"""Node-to-clip aggregation and clip scoring over the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.catalog.registry import big, digits, query
from cliptide.catalog.selection import depth_sql, scored_vectors
from cliptide.catalog.sqlparts import SCORED, mmr_ctes, unit
from cliptide.operators import nodes, scoring
from cliptide.plans import select

#: A clip is a run of 80 consecutive ids inside one label; node types alternate.
THRESHOLD = 0.15


def memory_nodes(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_vectors(spark, folder)
    return rows.select(
        "label",
        F.expr("cast(vec_id div 80 as string)").alias("clip_id"),
        F.col("vec_id").alias("node_id"),
        F.col("vec_id").alias("seq"),
        "relevance",
        "vector",
        F.when(F.col("vec_id") % 2 == 0, "episodic").otherwise("semantic").alias("memory_type"),
        F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("text"),
        "start",
        "end",
    )


def cluster_sql(threshold: float) -> str:
    """Leader clustering unrolled node by node; result ``agg`` has one row per (label, clip)."""
    parts = [
        """nodes AS (SELECT * FROM (SELECT label, CAST(vec_id // 80 AS VARCHAR) AS clip, vec_id AS node, rel, v, st,
  CASE WHEN vec_id % 2 = 0 THEN 'episodic' ELSE 'semantic' END AS kind, greatest(rel, 0.001) AS w,
  row_number() OVER (PARTITION BY label, vec_id // 80 ORDER BY rel DESC, vec_id) AS ix FROM scored) WHERE ix <= 8)""",
        f"""cl1 AS (SELECT label, clip, 1 AS cid, list_transform(v, lambda q: q * w) AS tot, w, {unit('v')} AS ctr,
  rel AS lead, node AS lnode, kind AS lkind FROM nodes WHERE ix = 1)""",
    ]
    for i in range(2, 9):
        parts.append(
            f"""b{i} AS MATERIALIZED (SELECT n.label, n.clip, n.node, n.rel, n.v, n.kind, n.w, c.cid AS bcid,
  round(list_dot_product(n.v, c.ctr), 9) AS sim FROM nodes n JOIN cl{i - 1} c ON c.label = n.label AND c.clip = n.clip
  WHERE n.ix = {i} QUALIFY row_number() OVER (PARTITION BY n.label, n.clip ORDER BY sim DESC, c.cid) = 1)"""
        )
        parts.append(
            f"""cl{i} AS MATERIALIZED (SELECT label, clip, cid, tot, w, {unit('tot')} AS ctr, lead, lnode, lkind FROM (
  SELECT c.label, c.clip, c.cid, CASE WHEN b.node IS NULL THEN c.tot ELSE
    list_transform(list_zip(c.tot, list_transform(b.v, lambda q: q * b.w)), lambda z: z[1] + z[2]) END AS tot,
    c.w + coalesce(b.w, 0) AS w, CASE WHEN b.rel > c.lead THEN b.rel ELSE c.lead END AS lead,
    CASE WHEN b.rel > c.lead THEN b.node ELSE c.lnode END AS lnode, CASE WHEN b.rel > c.lead THEN b.kind ELSE c.lkind END AS lkind
  FROM cl{i - 1} c LEFT JOIN b{i} b ON b.label = c.label AND b.clip = c.clip AND b.bcid = c.cid AND b.sim >= {threshold}
  UNION ALL SELECT label, clip, {i}, list_transform(v, lambda q: q * w), w, rel, node, kind FROM b{i} WHERE sim < {threshold}))"""
        )
    parts.append(
        f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY label, clip ORDER BY lead DESC, cid) AS r,
  count(*) OVER (PARTITION BY label, clip) AS m FROM cl8),
lw AS (SELECT *, CASE r WHEN 1 THEN 1.0 WHEN 2 THEN 0.35 WHEN 3 THEN 0.15 ELSE 0.05 END AS lwt FROM ranked),
sc AS (SELECT label, clip, any_value(m) AS m, sum(lwt * lead) FILTER (r <= 4) + CASE WHEN count(DISTINCT lkind) FILTER (r <= 3) = 2
    THEN 0.05 ELSE 0 END + 0.03 * least(any_value(m) - 1, 3) AS rel,
  string_agg(lnode, ',' ORDER BY r) FILTER (r <= 4) AS leaders, string_agg(DISTINCT lkind, ',' ORDER BY lkind) FILTER (r <= 3) AS kinds
  FROM lw GROUP BY label, clip),
vc AS (SELECT label, clip, list(x ORDER BY p) AS raw FROM (SELECT label, clip, p, sum(lwt * greatest(lead, 0.001) * ctr[p]) AS x
  FROM lw, (SELECT unnest(range(1, 65)) AS p) WHERE r <= 4 GROUP BY label, clip, p) GROUP BY label, clip),
nd AS (SELECT label, clip, string_agg(node, ',' ORDER BY ix) AS node_ids, min(st) AS st, max(st + 30) AS en FROM nodes GROUP BY label, clip),
agg AS (SELECT label, clip AS clip_id, rel, m, leaders, kinds, node_ids, st, en, {unit('raw')} AS v FROM sc JOIN vc USING (label, clip)
  JOIN nd USING (label, clip))"""
    )
    return ",\n".join(parts)


@query(
    "node_aggregate",
    f"""WITH {SCORED}, {cluster_sql(THRESHOLD)}
SELECT CAST(label AS BIGINT) AS label, clip_id, round(rel, 6) + 0.0 AS relevance, CAST(m AS BIGINT) AS cluster_count, leaders,
  kinds, node_ids, st AS start, en AS "end", round(v[1], 6) + 0.0 AS v1, round(list_sum(v), 6) + 0.0 AS vsum FROM agg""",
)
def node_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    settings = nodes.NodeSettings(cluster_threshold=THRESHOLD)
    out = nodes.aggregate_nodes(memory_nodes(spark, folder), ["label"], settings)
    return out.select(
        big("label"),
        "clip_id",
        digits("relevance"),
        F.col("metadata.cluster_count").cast("bigint").alias("cluster_count"),
        F.array_join("metadata.cluster_leaders", ",").alias("leaders"),
        F.array_join("metadata.memory_types", ",").alias("kinds"),
        F.array_join("metadata.node_ids", ",").alias("node_ids"),
        "start",
        "end",
        (F.round(F.element_at("vector", 1), 6) + 0.0).alias("v1"),
        (F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("vsum"),
    )


@query(
    "graph_select",
    f"""WITH {SCORED.replace('pool AS', 'unused AS')}, {cluster_sql(THRESHOLD)},
pool AS (SELECT label, clip_id, round(rel, 9) AS rel, v, st, row_number() OVER (PARTITION BY label ORDER BY round(rel, 9) DESC,
         st NULLS LAST, clip_id) AS ix FROM agg),
{mmr_ctes(6, 0.85)}, {depth_sql(max_k=5, start_k=1)}
SELECT CAST(t.label AS BIGINT) AS label, CAST(c.k AS BIGINT) AS selected_k, c.reason AS stop_reason, CAST(t.rank AS BIGINT) AS mmr_rank,
  t.clip_id FROM trace t JOIN chosen c USING (label) WHERE t.rank <= c.k""",
)
def graph_select(spark: SparkSession, folder: str) -> DataFrame:
    settings = nodes.NodeSettings(cluster_threshold=THRESHOLD)
    clips = nodes.aggregate_nodes(memory_nodes(spark, folder), ["label"], settings)
    clips = clips.withColumn("relevance", F.round("relevance", 9))
    chosen = select.select_evidence(clips, ["label"], select.STANDALONE_GRAPH)
    rows = chosen.select("label", "selected_k", "stop_reason", F.explode("selected").alias("item"))
    return rows.select(
        big("label"),
        big("selected_k"),
        "stop_reason",
        F.col("item.rank").cast("bigint").alias("mmr_rank"),
        F.col("item.clip_id").alias("clip_id"),
    )


_CLIPS = "clips AS (SELECT label, vec_id // 8 AS clip_id, rel FROM scored)"
for _mode, _fn in (("sum", "sum"), ("max", "max"), ("mean", "avg")):

    def _build(spark: SparkSession, folder: str, mode: str = _mode) -> DataFrame:
        rows = scored_vectors(spark, folder).withColumn("clip_id", F.expr("vec_id div 8"))
        scored = nodes.clip_scores(rows, ["label"], mode)
        return scored.select(big("label"), big("clip_id"), digits("score"))

    query(
        f"clip_score_{_mode}",
        f"WITH {SCORED}, {_CLIPS} SELECT CAST(label AS BIGINT) AS label, CAST(clip_id AS BIGINT) AS clip_id, "
        f"round({_fn}(rel), 6) + 0.0 AS score FROM clips GROUP BY label, clip_id",
    )(_build)


@query(
    "scene_boost",
    f"""WITH {SCORED}, {_CLIPS},
base AS (SELECT label, clip_id, max(rel) AS score FROM clips GROUP BY label, clip_id),
scene AS (SELECT label, vec_id // 8 AS sc, rel AS sim FROM scored WHERE rel > 0.05)
SELECT CAST(b.label AS BIGINT) AS label, CAST(b.clip_id AS BIGINT) AS clip_id, round(b.score + coalesce(0.2 * sum(s.sim), 0), 6) + 0.0 AS score
FROM base b LEFT JOIN scene s ON s.label = b.label AND b.clip_id BETWEEN s.sc - 5 AND s.sc GROUP BY b.label, b.clip_id, b.score""",
)
def scene_boost(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_vectors(spark, folder).withColumn("clip_id", F.expr("vec_id div 8"))
    clips = nodes.clip_scores(rows, ["label"], "max")
    scenes = rows.select(
        "label", F.col("clip_id").alias("scene_clip"), F.col("relevance").alias("sim")
    )
    boosted = nodes.scene_boost(clips, scenes, ["label"], 0.2, floor=0.05)
    return boosted.select(big("label"), big("clip_id"), digits("score"))


@query(
    "threshold_topk",
    f"""WITH {SCORED} SELECT CAST(label AS BIGINT) AS label, clip_id, CAST(rk AS BIGINT) AS rank, round(rel, 6) + 0.0 AS relevance FROM
(SELECT *, row_number() OVER (PARTITION BY label ORDER BY rel DESC, vec_id) AS rk FROM scored WHERE rel >= 0.05) WHERE rk <= 4""",
)
def threshold_topk(spark: SparkSession, folder: str) -> DataFrame:
    kept = scored_vectors(spark, folder).filter(F.col("relevance") >= 0.05)
    best = scoring.top_k(kept, ["label"], [F.desc("relevance"), F.asc("vec_id")], 4)
    return best.select(big("label"), "clip_id", big("rank"), digits("relevance"))


@query(
    "entity_match_margin",
    f"""WITH {SCORED}, r AS (SELECT label, vec_id, rel, row_number() OVER (PARTITION BY label ORDER BY rel DESC, vec_id) AS rk FROM scored),
p AS (SELECT label, max(vec_id) FILTER (rk = 1) AS vec_id, max(rel) FILTER (rk = 1) AS a, max(rel) FILTER (rk = 2) AS b FROM r GROUP BY label)
SELECT CAST(label AS BIGINT) AS label, CAST(vec_id AS BIGINT) AS vec_id, round(a, 6) + 0.0 AS best FROM p WHERE b IS NULL OR round(a - b, 9) >= 0.01""",
)
def entity_match_margin(spark: SparkSession, folder: str) -> DataFrame:
    best = scoring.confident_top1(scored_vectors(spark, folder), ["label"], "relevance", "vec_id", 0.01)
    return best.select(big("label"), big("vec_id"), digits("best"))


@query(
    "average_pair_similarity",
    f"""WITH {SCORED}, a AS (SELECT label, vec_id // 80 AS clip, v FROM scored WHERE vec_id % 2 = 0),
b AS (SELECT label, vec_id // 80 AS clip, v FROM scored WHERE vec_id % 2 = 1)
SELECT CAST(a.label AS BIGINT) AS label, CAST(a.clip AS BIGINT) AS clip, round(avg(list_dot_product(a.v, b.v)), 6) + 0.0 AS similarity
FROM a JOIN b ON a.label = b.label AND a.clip = b.clip GROUP BY a.label, a.clip""",
)
def average_pair_similarity(spark: SparkSession, folder: str) -> DataFrame:
    rows = memory_nodes(spark, folder).select("label", F.col("clip_id").cast("bigint").alias("clip"), "vector", "memory_type")
    even = rows.filter("memory_type = 'episodic'")
    odd = rows.filter("memory_type = 'semantic'")
    out = scoring.average_similarity(even, odd, "clip", "clip", ["label", "clip"], "vector")
    return out.select(big("label"), big("clip"), digits("similarity"))
