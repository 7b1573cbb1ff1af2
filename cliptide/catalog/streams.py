"""Streaming queries and the voice and face intermediates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.catalog import timeline  # noqa: F401  (its scene query is checked here too)
from cliptide.catalog.registry import ORACLES, big, digits, query, table
from cliptide.catalog.selection import scored_vectors
from cliptide.catalog.sqlparts import SCORED
from cliptide.operators import graph as G
from cliptide.operators import speakers as P
from cliptide.streaming import ordered, stateful


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a file stream, be it one file or a folder of files."""
    schema = table(spark, folder, name).schema
    # a stream takes a path without a pattern for a folder, and a pattern for whatever it names
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


@query("stream_scene_windows", ORACLES["scene_windows"])
def stream_scene_windows(spark: SparkSession, folder: str) -> DataFrame:
    last = table(spark, folder, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    turns = table_stream(spark, folder, "conversations").join(last, "conv_id")
    clips = turns.select("conv_id", "turn", "text", (F.col("turn") == F.col("last_turn")).alias("final"))
    scenes = stateful.scene_stream(clips, "conv_id", "turn", "text", "final")
    done = stateful.run_available(scenes, spark, "scenes")
    return done.select(
        big("conv_id"),
        big("scene"),
        F.col("last_clip").alias("last_turn"),
        big("clips"),
        F.array_join(F.col("members").cast("array<string>"), ",").alias("members"),
        big("fragments"),
    )


@query(
    "ordered_clips",
    """WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN n % 7 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN n % 7 = 0 THEN 'ValueError: length ' || n END AS error,
CASE WHEN n % 7 <> 0 THEN CAST(sum(CASE WHEN n % 7 <> 0 THEN n ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) END AS so_far FROM t""",
)
def ordered_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Letters said so far in each conversation; texts whose length seven divides fail and are left out."""
    turns = table_stream(spark, folder, "conversations").select("conv_id", "turn", "text")
    done = stateful.run_available(
        ordered.in_order(turns, "conv_id", "turn", ["text"], ordered.LengthFold("text", 7)), spark, "clips"
    )
    so_far = F.from_json("made", "array<struct<so_far: bigint>>")[0]["so_far"]
    return done.select(big("conv_id"), F.col("clip").alias("turn"), "status", "error", so_far.alias("so_far"))


@query("stream_entity_resolution")
def stream_entity_resolution(spark: SparkSession, folder: str) -> DataFrame:
    rows = table_stream(spark, folder, "embeddings").select("label", "vec_id", "embedding")
    resolved = stateful.resolve_entities(rows, "label", "vec_id", "embedding", 0.1)
    done = stateful.run_available(resolved, spark, "entities")
    return done.select(big("label"), big("vec_id"), big("node"))


@query("stream_memory_upsert")
def stream_memory_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a label as memories about two of five entities."""
    tag = lambda n: F.concat(F.lit("voice_"), n.cast("string"))
    rows = table_stream(spark, folder, "embeddings").select(
        "label", "vec_id", F.array(tag(F.col("vec_id") % 5), tag(F.col("vec_id") % 3)).alias("entities"), "embedding"
    )
    done = stateful.run_available(
        stateful.upsert_memories(rows, "label", "vec_id", "entities", "embedding", 0.2, -0.2), spark, "memories"
    )
    return done.select(big("label"), big("vec_id"), "action", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query(
    "best_faces",
    """WITH f AS (SELECT user_id, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
g AS (SELECT * FROM f WHERE value > 0.85 AND k > 22),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, k DESC, event_id) AS rk FROM g WHERE event_type <> 'error')
SELECT CAST(user_id AS BIGINT) AS user_id, event_type, CAST(event_id AS BIGINT) AS event_id, CAST(rk AS BIGINT) AS rank FROM r WHERE rk <= 3""",
)
def best_faces(spark: SparkSession, folder: str) -> DataFrame:
    faces = table(spark, folder, "events").select(
        "user_id",
        "event_type",
        "event_id",
        F.col("value").cast("string").alias("det"),
        F.get_json_object("props", "$.k").alias("quality"),
        F.when(F.col("event_type") == "error", -1).otherwise(F.crc32("event_type")).alias("cluster"),
    )
    best = P.best_faces(P.good_faces(faces, "det", "quality"), ["user_id"], "cluster", "det", "quality", "event_id")
    return best.select(big("user_id"), "event_type", big("event_id"), big("rank"))


@query(
    "active_segments",
    """WITH e AS (SELECT user_id, event_id AS t, value > 100 AS a FROM events), p AS (SELECT *, lag(a) OVER (PARTITION BY user_id ORDER BY t) AS was FROM e),
r AS (SELECT *, sum(CASE WHEN coalesce(was, FALSE) <> a THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM p),
s AS (SELECT user_id, run, bool_or(a) AS on_, min(t) AS st, max(t) AS la FROM r GROUP BY user_id, run),
n AS (SELECT *, lead(st) OVER (PARTITION BY user_id ORDER BY run) AS nx FROM s)
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(st AS BIGINT) AS start, CAST(coalesce(nx, la) AS BIGINT) AS "end" FROM n WHERE on_""",
)
def active_segments(spark: SparkSession, folder: str) -> DataFrame:
    frames = table(spark, folder, "events").select("user_id", "event_id", (F.col("value") > 100).alias("active"))
    out = P.active_segments(frames, ["user_id"], "event_id", "active", F.floor(F.col("event_id") / 4096))
    return out.select(big("user_id"), big("start"), big("end"))


@query(
    "padded_spans",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS st, epoch_us(ts) // 1000 + CAST(round(value * 1000) AS BIGINT) AS en FROM events),
p AS (SELECT user_id, event_id, greatest(st - 200, 0) AS st, en + 200 AS en FROM e),
f AS (SELECT *, CASE WHEN st - max(en) OVER w > 750 OR max(en) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM p WINDOW w AS (PARTITION BY user_id ORDER BY st, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY st, event_id) AS i FROM f)
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(min(st) // 1000 AS BIGINT) AS start_second, CAST(greatest((max(en) + 999) // 1000, min(st) // 1000 + 1) AS BIGINT) AS end_second FROM g GROUP BY user_id, i""",
)
def padded_spans(spark: SparkSession, folder: str) -> DataFrame:
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    spans = table(spark, folder, "events").select(
        "user_id",
        F.col("event_id").alias("tie"),
        start.alias("start"),
        (start + F.round(F.col("value") * 1000).cast("bigint")).alias("end"),
    )
    out = P.padded_spans(spans, ["user_id"], F.floor(F.col("start") / 21_600_000))
    return out.select(big("user_id"), big("start_second"), big("end_second"))


@query(
    "label_codes",
    "WITH f AS (SELECT source, min(doc_id) AS f FROM documents GROUP BY source) SELECT source, CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS code FROM f",
)
def label_codes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("source", "doc_id")
    return P.label_codes(docs, "source", "doc_id").select("source", big("code"))


@query(
    "utterance_means",
    """WITH c AS (SELECT label, vec_id // 8 AS utt, p, avg(embedding[p]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS p) GROUP BY ALL)
SELECT CAST(label AS BIGINT) AS label, CAST(utt AS BIGINT) AS utterance, round(sum(x), 6) + 0.0 AS total, round(max(x) FILTER (p = 1), 6) + 0.0 AS first FROM c GROUP BY label, utt""",
)
def utterance_means(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "embeddings").select("label", F.expr("vec_id div 8").alias("utterance"), "embedding")
    means = P.utterance_means(chunks, ["label", "utterance"], "embedding")
    return means.select(
        big("label"),
        big("utterance"),
        (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("total"),
        (F.round(F.element_at("embedding", 1), 6) + 0.0).alias("first"),
    )


@query(
    "speaker_clusters",
    f"""WITH RECURSIVE {SCORED}, pr AS (SELECT a.label, a.vec_id AS x, b.vec_id AS y FROM unitv a JOIN unitv b ON a.label = b.label AND a.vec_id <> b.vec_id
AND round(list_dot_product(a.v, b.v), 9) >= 0.4),
re(label, x, y) AS (SELECT label, vec_id, vec_id FROM unitv UNION SELECT r.label, r.x, p.y FROM re r JOIN pr p ON p.label = r.label AND p.x = r.y),
roots AS (SELECT label, x, min(y) AS root FROM re GROUP BY label, x)
SELECT CAST(label AS BIGINT) AS label, CAST(x AS BIGINT) AS vec_id, CAST(dense_rank() OVER (PARTITION BY label ORDER BY root) - 1 AS BIGINT) AS speaker FROM roots""",
)
def speaker_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each label is a recording of any length."""
    chunks = table(spark, folder, "embeddings").select("label", "vec_id", "embedding")
    out = P.cluster_recordings(chunks, ["label"], "vec_id", "embedding", 0.4)
    return out.select(big("label"), big("vec_id"), big("speaker"))


@query("split_overlaps")
def split_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("string").alias("recording")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, folder, "events").select(
        hour, "event_id", start.alias("start"), (start + F.col("value")).alias("end"), F.col("user_id").alias("speaker")
    )
    out = P.split_overlaps(rows, ["recording"], "event_id", F.floor(F.col("start") / 600))
    return out.select("recording", digits("start", 3), digits("end", 3), big("speaker"))


@query(
    "entity_info",
    f"""WITH {SCORED}, n AS (SELECT label, vec_id, v, round(1 + rel, 3) AS w FROM scored)
SELECT CAST(a.label AS BIGINT) AS label, CAST(a.vec_id AS BIGINT) AS vec_id FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.label = a.label AND b.vec_id <> a.vec_id
AND round(list_dot_product(a.v, b.v), 9) > 0.25 AND (b.w > a.w OR (b.w = a.w AND b.vec_id < a.vec_id)))""",
)
def entity_info(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each entity without the near copies of heavier ones."""
    rows = scored_vectors(spark, folder).select("label", "vec_id", "vector", F.round(1 + F.col("relevance"), 3).alias("weight"))
    kept = G.without_near_copies(rows, ["label"], "vec_id", "vector", "weight", 0.25)
    return kept.select(big("label"), big("vec_id"))
