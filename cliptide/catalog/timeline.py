"""Interval, look-back and count-window queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.catalog.registry import big, digits, query, table
from cliptide.functions import times
from cliptide.operators import carry, intervals, windows
from cliptide.operators.carry import Running

HOUR = 3_600_000_000
GRID = 600_000_000


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as an interval of ``value`` seconds, in microseconds."""
    start = times.micros(F.col("ts"))
    return table(spark, folder, "events").select(
        "user_id",
        "event_id",
        "event_type",
        start.alias("start"),
        (start + F.round(F.col("value") * 1_000_000).cast("bigint")).alias("end"),
    )


SPANS = """sp AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS st, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS en FROM events)"""


def chunk_of(column: str = "start", width: int = 6 * HOUR):
    return F.floor(F.col(column) / width)


@query(
    "interval_overlap_join",
    f"""WITH {SPANS} SELECT CAST(a.event_id AS BIGINT) AS caption_id, CAST(b.event_id AS BIGINT) AS subtitle_id,
CAST(least(a.en, b.en) - greatest(a.st, b.st) AS BIGINT) AS shared_us FROM sp a JOIN sp b ON a.user_id = b.user_id AND a.event_id <> b.event_id
AND a.st < b.en AND b.st < a.en""",
)
def interval_overlap_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = spans(spark, folder)
    pairs = intervals.overlap_join(rows, rows, ["user_id"], ("start", "end"), GRID)
    kept = pairs.filter("l_event_id <> r_event_id")
    return kept.select(
        F.col("l_event_id").alias("caption_id"),
        F.col("r_event_id").alias("subtitle_id"),
        intervals.overlap_length(("start", "end")).cast("bigint").alias("shared_us"),
    )


@query(
    "overlap_speakers",
    f"""WITH {SPANS}, sh AS (SELECT a.user_id, a.event_type AS grp, b.event_type AS spk, sum(least(a.en, b.en) - greatest(a.st, b.st)) AS sh
FROM sp a JOIN sp b ON a.user_id = b.user_id AND a.st < b.en AND b.st < a.en AND a.event_type <> b.event_type GROUP BY ALL),
own AS (SELECT user_id, event_type AS spk, sum(en - st) * 0.5 AS half FROM sp GROUP BY ALL)
SELECT CAST(sh.user_id AS BIGINT) AS user_id, grp, sh.spk AS speaker, CAST(sh AS BIGINT) AS shared FROM sh JOIN own ON own.user_id = sh.user_id AND own.spk = sh.spk
WHERE sh > least(half, 500000)""",
)
def overlap_speakers(spark: SparkSession, folder: str) -> DataFrame:
    rows = spans(spark, folder).withColumn("group", F.col("event_type"))
    found = intervals.overlapping_speakers(
        rows, rows.withColumnRenamed("event_type", "speaker").drop("group"), ["user_id"], "group", "speaker", GRID, 500_000.0
    )
    return found.filter("group <> speaker").select(
        big("user_id"), F.col("group").alias("grp"), "speaker", big("shared")
    )


@query(
    "interval_merge",
    f"""WITH {SPANS}, f AS (SELECT *, CASE WHEN st > max(en) OVER w OR max(en) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM sp
WINDOW w AS (PARTITION BY user_id ORDER BY st, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY st, event_id) AS i FROM f)
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(min(st) AS BIGINT) AS start_us, CAST(max(en) AS BIGINT) AS end_us, CAST(count(*) AS BIGINT) AS members
FROM g GROUP BY user_id, i""",
)
def interval_merge(spark: SparkSession, folder: str) -> DataFrame:
    merged = intervals.merge_intervals(spans(spark, folder), ["user_id"], "event_id", chunk_of())
    return merged.select(
        big("user_id"), F.col("start").alias("start_us"), F.col("end").alias("end_us"), big("members")
    )


_MERGED = """{n}f AS (SELECT *, CASE WHEN st > max(en) OVER w OR max(en) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM sp WHERE {cond}
WINDOW w AS (PARTITION BY user_id ORDER BY st, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{n}g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY st, event_id) AS i FROM {n}f),
{n} AS (SELECT user_id, min(st) AS st, max(en) AS en FROM {n}g GROUP BY user_id, i)"""
_A = _MERGED.format(n="ma", cond="event_type IN ('click', 'view')")
_B = _MERGED.format(n="mb", cond="event_type NOT IN ('click', 'view')")


@query(
    "interval_iou",
    f"""WITH {SPANS}, {_A}, {_B}, i AS (SELECT a.user_id, sum(least(a.en, b.en) - greatest(a.st, b.st)) AS x FROM ma a JOIN mb b
ON a.user_id = b.user_id AND a.st < b.en AND b.st < a.en GROUP BY a.user_id),
la AS (SELECT user_id, sum(en - st) AS l FROM ma GROUP BY user_id), lb AS (SELECT user_id, sum(en - st) AS l FROM mb GROUP BY user_id),
u AS (SELECT coalesce(la.user_id, lb.user_id) AS user_id, coalesce(la.l, 0) AS a, coalesce(lb.l, 0) AS b FROM la FULL JOIN lb ON la.user_id = lb.user_id)
SELECT CAST(u.user_id AS BIGINT) AS user_id, CAST(coalesce(x, 0) AS BIGINT) AS inter_us, CAST(a + b - coalesce(x, 0) AS BIGINT) AS union_us,
round(CASE WHEN a + b - coalesce(x, 0) > 0 THEN coalesce(x, 0) / (a + b - coalesce(x, 0)) ELSE 0.0 END, 6) + 0.0 AS iou FROM u LEFT JOIN i ON i.user_id = u.user_id""",
)
def interval_iou(spark: SparkSession, folder: str) -> DataFrame:
    rows = spans(spark, folder)
    inside = F.col("event_type").isin("click", "view")
    iou = intervals.interval_iou(rows.filter(inside), rows.filter(~inside), ["user_id"], "event_id", GRID * 6)
    return iou.select(
        big("user_id"),
        F.col("inter").cast("bigint").alias("inter_us"),
        F.col("union").cast("bigint").alias("union_us"),
        digits("iou"),
    )


@query(
    "mean_iou",
    f"""WITH {SPANS}, {_A}, {_B}, i AS (SELECT a.user_id, sum(least(a.en, b.en) - greatest(a.st, b.st)) AS x FROM ma a JOIN mb b
ON a.user_id = b.user_id AND a.st < b.en AND b.st < a.en GROUP BY a.user_id),
la AS (SELECT user_id, sum(en - st) AS l FROM ma GROUP BY user_id), lb AS (SELECT user_id, sum(en - st) AS l FROM mb GROUP BY user_id),
u AS (SELECT coalesce(la.user_id, lb.user_id) AS user_id, coalesce(la.l, 0) AS a, coalesce(lb.l, 0) AS b FROM la FULL JOIN lb ON la.user_id = lb.user_id)
SELECT round(100 * avg(CASE WHEN a + b - coalesce(x, 0) > 0 THEN coalesce(x, 0) / (a + b - coalesce(x, 0)) ELSE 0.0 END), 6) + 0.0 AS miou,
CAST(count(*) AS BIGINT) AS num_evaluated FROM u LEFT JOIN i ON i.user_id = u.user_id""",
)
def mean_iou(spark: SparkSession, folder: str) -> DataFrame:
    rows = spans(spark, folder)
    inside = F.col("event_type").isin("click", "view")
    iou = intervals.interval_iou(rows.filter(inside), rows.filter(~inside), ["user_id"], "event_id", GRID * 6)
    return iou.agg(
        (F.round(F.avg("iou") * 100, 6) + 0.0).alias("miou"), F.count("*").alias("num_evaluated")
    )


@query(
    "lookback_join",
    f"""WITH {SPANS} SELECT CAST(q.event_id AS BIGINT) AS query_id, CAST(count(c.event_id) AS BIGINT) AS cues, CAST(min(c.st) AS BIGINT) AS first_us
FROM sp q JOIN sp c ON c.user_id = q.user_id AND c.st <= q.st AND c.st >= q.st - {6 * HOUR} GROUP BY q.event_id""",
)
def lookback_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = spans(spark, folder)
    queries = rows.select("user_id", F.col("event_id").alias("query_id"), F.col("start").alias("at"))
    cues = rows.select("user_id", "event_id", F.col("start").alias("cue_at"))
    joined = intervals.look_back_join(queries, cues, ["user_id"], "at", "cue_at", 6 * HOUR)
    return joined.groupBy("query_id").agg(F.count("*").alias("cues"), F.min("cue_at").alias("first_us"))


@query(
    "scene_lookup",
    f"""WITH {SPANS}, s AS (SELECT user_id, st // {HOUR} AS clip FROM sp WHERE event_type = 'purchase'),
l AS (SELECT DISTINCT user_id, st // {HOUR} AS clip FROM sp)
SELECT CAST(l.user_id AS BIGINT) AS user_id, CAST(l.clip AS BIGINT) AS clip, CAST(min(s.clip) AS BIGINT) AS scene FROM l LEFT JOIN s ON s.user_id = l.user_id
AND s.clip >= l.clip GROUP BY l.user_id, l.clip""",
)
def scene_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = spans(spark, folder).withColumn("clip", F.floor(F.col("start") / HOUR))
    clips = rows.select("user_id", "clip").distinct()
    scenes = rows.filter("event_type = 'purchase'").select("user_id", F.col("clip").alias("scene_clip"))
    found = intervals.next_at_or_after(clips, scenes, ["user_id"], "clip", "scene_clip", 24)
    return found.select(big("user_id"), big("clip"), F.col("next").alias("scene"))


@query(
    "merge_turns",
    f"""WITH {SPANS}, a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY st, event_id) THEN 1 ELSE 0 END AS ch FROM sp),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY st, event_id) AS run FROM a),
f AS (SELECT *, CASE WHEN st - max(en) OVER w > {6 * HOUR} OR max(en) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM r
      WINDOW w AS (PARTITION BY user_id, run ORDER BY st, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(o) OVER (PARTITION BY user_id, run ORDER BY st, event_id) AS i FROM f)
SELECT CAST(user_id AS BIGINT) AS user_id, event_type, CAST(min(st) AS BIGINT) AS start_us, CAST(max(en) AS BIGINT) AS end_us, CAST(count(*) AS BIGINT) AS turns
FROM g GROUP BY user_id, run, i, event_type""",
)
def merge_turns(spark: SparkSession, folder: str) -> DataFrame:
    merged = intervals.merge_turns(
        spans(spark, folder), ["user_id"], "event_type", "event_id", chunk_of(width=24 * HOUR), 6 * HOUR
    )
    return merged.select(
        big("user_id"),
        "event_type",
        F.col("start").alias("start_us"),
        F.col("end").alias("end_us"),
        big("turns"),
    )


@query(
    "dialogue_edges",
    f"""WITH {SPANS}, p AS (SELECT st // {HOUR} AS clip, event_id, user_id, st, lag(user_id) OVER w AS pu, lag(en) OVER w AS pe FROM sp
WINDOW w AS (PARTITION BY st // {HOUR} ORDER BY st, event_id))
SELECT CAST(clip AS BIGINT) AS clip, CAST(event_id AS BIGINT) AS event_id, CAST(least(pu, user_id) AS BIGINT) AS src,
CAST(greatest(pu, user_id) AS BIGINT) AS dst, 0.5::DOUBLE AS weight FROM p WHERE pu <> user_id AND st - pe <= 2000000""",
)
def dialogue_edges(spark: SparkSession, folder: str) -> DataFrame:
    turns = spans(spark, folder).withColumn("clip", F.floor(F.col("start") / HOUR))
    links = intervals.dialogue_links(turns, ["clip"], "user_id", "event_id", chunk_of(width=GRID), 2_000_000)
    return links.select(big("clip"), big("event_id"), big("src"), big("dst"), "weight")


@query(
    "chunk_windows",
    f"""WITH {SPANS}, c AS (SELECT event_id, st, en, unnest(range(0, greatest(CAST(ceil((en - st - 750000) / 750000.0) AS BIGINT), 0))) AS i FROM sp)
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(count(*) AS BIGINT) AS chunks, CAST(max(least(st + i * 750000 + 1500000, en)) AS BIGINT) AS last_end,
CAST(sum(least(st + i * 750000 + 1500000, en) - (st + i * 750000)) AS BIGINT) AS total_us FROM c GROUP BY event_id""",
)
def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    pieces = times.overlapping_chunks(
        F.col("start"), F.col("end"), F.lit(1_500_000).cast("bigint"), F.lit(750_000).cast("bigint")
    )
    rows = spans(spark, folder).select("event_id", F.explode(pieces).alias("p"))
    return rows.groupBy("event_id").agg(
        F.count("*").alias("chunks"),
        F.max("p.end").alias("last_end"),
        F.sum(F.col("p.end") - F.col("p.start")).alias("total_us"),
    )


TURN_CHUNK = 1024


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")


def turn_chunk():
    return F.floor(F.col("turn") / TURN_CHUNK)


@query(
    "scene_windows",
    """WITH c AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 6 AS scene FROM conversations)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(scene AS BIGINT) AS scene, CAST(max(turn) AS BIGINT) AS last_turn, CAST(count(*) AS BIGINT) AS clips,
string_agg(turn, ',' ORDER BY turn) AS members, CAST(least(20, count(*) FILTER (len(trim(text)) > 0)) AS BIGINT) AS fragments
FROM c GROUP BY conv_id, scene HAVING count(*) FILTER (len(trim(text)) > 0) > 0""",
)
def scene_windows(spark: SparkSession, folder: str) -> DataFrame:
    scenes = windows.scene_windows(turns(spark, folder), ["conv_id"], "turn", "text", turn_chunk())
    return scenes.select(
        big("conv_id"),
        big("scene"),
        F.col("last_clip").alias("last_turn"),
        big("clips"),
        F.array_join(F.col("members").cast("array<string>"), ",").alias("members"),
        F.size("fragments").cast("bigint").alias("fragments"),
    )


@query(
    "rolling_context",
    """WITH c AS (SELECT conv_id, turn, string_agg(md5(text), ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ctx FROM conversations)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(ctx, '') AS context FROM c""",
)
def rolling_context(spark: SparkSession, folder: str) -> DataFrame:
    rows = turns(spark, folder).withColumn("digest", F.md5(F.encode("text", "utf-8")))
    context = windows.rolling_context(rows, ["conv_id"], ["turn"], "digest", turn_chunk(), 3)
    return context.select(big("conv_id"), big("turn"), F.array_join("context", ",").alias("context"))


@query(
    "prior_carry",
    """WITH c AS (SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' THEN md5(text) END IGNORE NULLS) OVER
(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM conversations)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(prior, '(none)') AS prior FROM c""",
)
def prior_carry(spark: SparkSession, folder: str) -> DataFrame:
    summary = F.when(F.col("role") == "assistant", F.md5(F.encode("text", "utf-8")))
    rows = windows.previous_known(turns(spark, folder), ["conv_id"], ["turn"], summary, turn_chunk(), "prior")
    return rows.select(big("conv_id"), big("turn"), F.coalesce("prior", F.lit("(none)")).alias("prior"))


@query(
    "row_batches",
    """WITH c AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 32 AS b FROM events)
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(b AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, CAST(min(event_id) AS BIGINT) AS first_event FROM c GROUP BY user_id, b""",
)
def row_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", "event_id")
    batched = windows.batches(rows, ["user_id"], ["event_id"], F.floor(F.col("event_id") / 4096), 32)
    return batched.groupBy(big("user_id"), big("batch")).agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_event")
    )


@query(
    "frame_stack",
    """WITH f AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
s AS (SELECT conv_id, pos, n, unnest(range(0, 5)) AS slot FROM f WHERE pos % 2 = 0),
j AS (SELECT s.conv_id, s.pos, s.slot, f.turn FROM s JOIN f ON f.conv_id = s.conv_id AND f.pos = least(greatest(s.pos - 2 + s.slot, 0), s.n - 1))
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(pos AS BIGINT) AS centre, string_agg(turn, ',' ORDER BY slot) AS stack FROM j GROUP BY conv_id, pos""",
)
def frame_stack(spark: SparkSession, folder: str) -> DataFrame:
    rows = carry.position(turns(spark, folder), ["conv_id"], ["turn"], turn_chunk(), "pos")
    lengths = rows.groupBy("conv_id").agg(F.count("*").alias("length"))
    frames = rows.withColumn("pos", F.col("pos") - 1).join(lengths, "conv_id")
    stacked = windows.stacked_frames(frames, ["conv_id"], "pos", "turn", 5, 2, "length")
    return stacked.select(
        big("conv_id"), big("centre"), F.array_join(F.col("stack").cast("array<string>"), ",").alias("stack")
    )


@query(
    "static_runs",
    """WITH d AS (SELECT user_id, event_id, CASE WHEN value < 60 THEN 1 ELSE 0 END AS calm FROM events),
g AS (SELECT *, sum(1 - calm) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM d)
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(min(event_id) AS BIGINT) AS first_event, CAST(count(*) AS BIGINT) AS frames
FROM g WHERE calm = 1 GROUP BY user_id, grp HAVING count(*) >= 3""",
)
def static_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", "event_id", (F.col("value") < 60).alias("calm"))
    breaks = F.when(F.col("calm"), 0).otherwise(1)
    grouped = carry.running(
        rows, ["user_id"], ["event_id"], F.floor(F.col("event_id") / 4096), {"grp": Running("sum", breaks)}
    )
    runs = grouped.filter("calm").groupBy("user_id", "grp").agg(
        F.min("event_id").alias("first_event"), F.count("*").alias("frames")
    )
    return runs.filter("frames >= 3").select(big("user_id"), big("first_event"), big("frames"))


@query(
    "clip_labels",
    """WITH s AS (SELECT event_id, value, CAST(round_even(value, 0) AS BIGINT) AS w FROM events)
SELECT CAST(event_id AS BIGINT) AS event_id, printf('%02d:%02d:%02d', w // 3600, (w % 3600) // 60, w % 60) AS label,
printf('%02d:%02d', CAST(floor(value) AS BIGINT) // 60, CAST(floor(value) AS BIGINT) % 60) AS mmss,
printf('%02d:%02d:%02d --> %02d:%02d:%02d', event_id * 30 // 3600, (event_id * 30 % 3600) // 60, event_id * 30 % 60,
 (event_id * 30 + 30) // 3600, ((event_id * 30 + 30) % 3600) // 60, (event_id * 30 + 30) % 60) AS clip,
CAST(w AS DOUBLE) AS seconds_back, CAST(floor(value) AS BIGINT) * 1000 AS ms_back FROM s""",
)
def clip_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    label, mmss = times.format_seconds(F.col("value")), times.format_mmss(F.col("value"))
    return rows.select(
        big("event_id"),
        label.alias("label"),
        mmss.alias("mmss"),
        times.clip_label(F.col("event_id")).alias("clip"),
        times.parse_seconds(label).alias("seconds_back"),
        times.clock_to_ms(mmss).alias("ms_back"),
    )
