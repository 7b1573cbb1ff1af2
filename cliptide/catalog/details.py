"""Sources, parsers and small graph reports over the bundled tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.catalog.graphs import CAP, EV, captions, told_events, user_graphs, _UG
from cliptide.catalog.registry import big, digits, query, table, text_table
from cliptide.catalog.selection import scored_vectors
from cliptide.catalog.sqlparts import SCORED, unit
from cliptide.functions import parsing as P
from cliptide.functions import times
from cliptide.functions import vectors as V
from cliptide.operators import graph as G
from cliptide.operators import hints
from cliptide.operators import identity as I
from cliptide.operators import scoring
from cliptide.operators import speakers
from cliptide.session import broadcast_when_small, ensure_checkpoint_dir
from cliptide.sources import captions as C
from cliptide.sources import elements
from cliptide.sources import subtitles as S


def subtitle_files(spark: SparkSession, folder: str) -> DataFrame:
    """A subtitle file per conversation: a cue of four lines per turn, four seconds each."""
    def clock(seconds: Column, part: str) -> Column:
        return F.concat(F.lit("00:00:"), F.lpad(seconds.cast("string"), 2, "0"), F.lit(part))

    begin = F.col("turn") * 4
    line = F.concat(F.lit("<i>"), F.regexp_replace("text", "[\r\n]+", " "), F.lit("</i>"))
    cue = F.concat_ws("\n", (F.col("turn") + 1).cast("string"), F.concat(clock(begin, ",250"), F.lit(" --> "), clock(begin + 3, ",750")), line, F.lit(""))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", cue.alias("cue"))
    cues = F.array_sort(F.collect_list(F.struct("turn", "cue")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(cues, lambda c: c["cue"]), "\n").alias("text"))


_CUES = "cu AS (SELECT conv_id, turn, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS flat FROM conversations)"


@query(
    "spoken_lines",
    f"""WITH {_CUES}, s AS (SELECT conv_id, turn, regexp_replace(trim('<i>' || flat || '</i>'), '<.*?>', '', 'g') AS line FROM cu WHERE NOT contains(flat, '-->'))
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn * 4 + 2 AS BIGINT) AS pos, line FROM s WHERE length(line) > 0""",
)
def spoken_lines(spark: SparkSession, folder: str) -> DataFrame:
    out = S.srt_lines(subtitle_files(spark, folder), ["conv_id"], include_time=False)
    return out.select(big("conv_id"), big("pos"), "line")


@query(
    "subtitle_blocks",
    f"""WITH {_CUES} SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS index, turn * 4 + 0.25::DOUBLE AS start, turn * 4 + 3.75::DOUBLE AS "end",
'00:00:' || lpad(CAST(turn * 4 AS VARCHAR), 2, '0') || ' --> 00:00:' || lpad(CAST(turn * 4 + 4 AS VARCHAR), 2, '0') AS time_label, trim('<i>' || flat || '</i>') AS text FROM cu""",
)
def subtitle_blocks(spark: SparkSession, folder: str) -> DataFrame:
    out = S.timed_blocks(subtitle_files(spark, folder), ["conv_id"])
    return out.select(big("conv_id"), big("index"), digits("start", 3), digits("end", 3), "time_label", "text")


@query(
    "second_cues",
    f"""WITH {_CUES} SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn * 4 + 1 AS BIGINT) AS pos, CAST(turn * 4 AS BIGINT) AS start, CAST(turn * 4 + 3 AS BIGINT) AS "end",
'<i>' || flat || '</i>' AS text FROM cu""",
)
def second_cues(spark: SparkSession, folder: str) -> DataFrame:
    out = S.whole_second_cues(subtitle_files(spark, folder), ["conv_id"])
    return out.select(big("conv_id"), big("pos"), big("start"), big("end"), "text")


@query(
    "caption_spans",
    """WITH l AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)) AS ls FROM documents WHERE length(text) > 0),
u AS (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM l), s AS (SELECT doc_id, i, i * 30 AS st, i * 30 + 30 AS en, ls[i + 1] AS line FROM u WHERE i % 2 = 0)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(i // 2 AS BIGINT) AS index, CAST(st AS BIGINT) AS start, CAST(en AS BIGINT) AS "end",
lpad(CAST(st // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(st % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(st % 60 AS VARCHAR), 2, '0') || ' --> ' ||
lpad(CAST(en // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(en % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(en % 60 AS VARCHAR), 2, '0') AS time_label, md5(line) AS line FROM s""",
)
def caption_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every other line of a document as a caption of half a minute."""
    out = C.caption_blocks(text_table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"], stride=2)
    return out.select(big("doc_id"), big("index"), big("start"), big("end"), "time_label", F.md5(F.col("text").cast("binary")).alias("line"))


@query(
    "clean_captions",
    """WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Clip. Visual caption: ' || text || ' ASR transcript: gone' WHEN 1 THEN text || 'ASR transcript:' || text ELSE text END AS t FROM conversations),
h AS (SELECT conv_id, turn, string_split(t, 'ASR transcript:')[1] AS t FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, trim(regexp_replace(CASE WHEN strpos(t, 'Visual caption:') > 0
THEN left(t, strpos(t, 'Visual caption:') - 1) || substr(t, strpos(t, 'Visual caption:') + 15) ELSE t END, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM h""",
)
def clean_captions(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    tail = F.lit("ASR transcript:")
    text = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Clip. Visual caption: "), "text", F.lit(" "), tail, F.lit(" gone")))
        .when(F.col("turn") % 3 == 1, F.concat("text", tail, "text"))
        .otherwise(F.col("text"))
    )
    return turns.select(big("conv_id"), big("turn"), C.clean_caption(text).alias("text"))


@query(
    "segment_checks",
    f"""WITH {EV}, s AS (SELECT event_id, k % 4 AS m1, k % 70 AS s1, k % 5 AS m2, CAST(floor(value) AS BIGINT) % 75 AS s2 FROM ev)
SELECT CAST(event_id AS BIGINT) AS event_id, s1 < 60 AND s2 < 60 AND m1 * 60 + s1 < m2 * 60 + s2 AND m2 * 60 + s2 <= 240 AS valid FROM s""",
)
def segment_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of an audio of four minutes, some with unreadable seconds."""
    ev = told_events(spark, folder)
    stamp = lambda m, s: F.format_string("%02d:%02d", m, s)
    start = stamp(F.col("k") % 4, F.col("k") % 70)
    end = stamp(F.col("k") % 5, F.floor("value").cast("bigint") % 75)
    return ev.select(big("event_id"), times.valid_segment(start, end, F.lit(240)).alias("valid"))


@query(
    "long_voices",
    f"""WITH {EV} SELECT CAST(user_id AS BIGINT) AS user_id, CAST(count(*) AS BIGINT) AS voices, round(min(value), 6) + 0.0 AS shortest FROM ev WHERE value >= 2 GROUP BY user_id""",
)
def long_voices(spark: SparkSession, folder: str) -> DataFrame:
    kept = speakers.long_enough(told_events(spark, folder), "value")
    return kept.groupBy(big("user_id")).agg(F.count("*").alias("voices"), (F.round(F.min("value"), 6) + 0.0).alias("shortest"))


@query(
    "float_grids",
    f"""WITH {EV}, n AS (SELECT event_id, list_distinct([least(greatest(x, 1e-6), 1.0) FOR x IN [k / 100.0::DOUBLE, value::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE]]) AS l FROM ev)
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(len(l) AS BIGINT) AS numbers, round(list_min(l), 6) + 0.0 AS low, round(list_sum(l), 6) + 0.0 AS total FROM n""",
)
def float_grids(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat_ws(" , ", (F.col("k") / 100).cast("string"), F.col("value").cast("string"), F.lit("bad"), F.lit("0"), F.lit("0.5"))
    rows = told_events(spark, folder).select("event_id", P.float_list(text).alias("l"))
    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        big("event_id"), F.size("l").cast("bigint").alias("numbers"), (F.round(F.get("l", 0), 6) + 0.0).alias("low"), (F.round(total, 6) + 0.0).alias("total")
    )


@query(
    "reply_scores",
    f"""WITH {EV} SELECT CAST(event_id AS BIGINT) AS event_id, round(CASE event_type WHEN 'click' THEN k WHEN 'view' THEN k + value WHEN 'error' THEN 0 ELSE value END, 6) + 0.0::DOUBLE AS score FROM ev""",
)
def reply_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Judge replies in the shapes that name a total, single scores, no number or some numbers."""
    k, value = F.col("k").cast("string"), F.col("value").cast("string")
    reply = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("score: 3, total score: "), k))
        .when(F.col("event_type") == "view", F.concat(F.lit("Clarity score: "), k, F.lit("; depth Score : "), value))
        .when(F.col("event_type") == "error", F.lit("no number at all"))
        .otherwise(F.concat(F.lit("between 1 and "), value))
    )
    return told_events(spark, folder).select(big("event_id"), (F.round(P.total_score(reply), 6) + 0.0).alias("score"))


@query(
    "memory_merges",
    f"""WITH {EV}, l AS (SELECT event_id, ['click', event_type, CAST(k % 3 AS VARCHAR), event_type, 'view'] AS l FROM ev)
SELECT CAST(event_id AS BIGINT) AS event_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS texts FROM l""",
)
def memory_merges(spark: SparkSession, folder: str) -> DataFrame:
    given = F.array("event_type", F.lit("view"))
    extra = F.array(F.lit("click"), "event_type", (F.col("k") % 3).cast("string"))
    merged = P.merged_memories(given, extra, "prepend")
    return told_events(spark, folder).select(big("event_id"), F.array_join(merged, ",").alias("texts"))


@query(
    "clip_texts",
    f"""WITH {EV}, t AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN 'Memory evidence from CLIP_' || k || '.' ELSE event_type || chr(10) || CAST(user_id AS VARCHAR) END AS t FROM ev)
SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN length(t) > 8 THEN rtrim(left(t, 8)) || '...' ELSE t END AS text FROM t""",
)
def clip_texts(spark: SparkSession, folder: str) -> DataFrame:
    none = F.array(F.lit(""), F.lit(""))
    texts = F.when(F.col("k") % 4 == 0, none).otherwise(F.array("event_type", F.col("user_id").cast("string")))
    return told_events(spark, folder).select(big("event_id"), P.clip_text(texts, F.col("k"), 8).alias("text"))


@query(
    "option_answers",
    f"""WITH {EV}, a AS (SELECT event_id, chr(65 + CAST(k % 5 AS INTEGER)) AS said, chr(65 + CAST(user_id % 5 AS INTEGER)) AS wanted, event_type AS t, k % 3 AS form FROM ev)
SELECT CAST(event_id AS BIGINT) AS event_id, CASE form WHEN 0 THEN said = wanted WHEN 1 THEN said = wanted AND t = 'view' ELSE t = 'view' END AS same FROM a""",
)
def option_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Replies of a letter alone, a letter with a text, and a text alone, against a letter and the text ``view``."""
    said = F.char(F.col("k") % 5 + 65)
    reply = (
        F.when(F.col("k") % 3 == 0, said)
        .when(F.col("k") % 3 == 1, F.concat(F.lit("**Answer: "), said, F.lit(") "), "event_type", F.lit("**")))
        .otherwise(F.col("event_type"))
    )
    same = P.option_match(reply, F.char(F.col("user_id") % 5 + 65), F.lit("view"))
    return told_events(spark, folder).select(big("event_id"), same.alias("same"))


@query(
    "open_answers",
    f"""WITH {EV} SELECT CAST(event_id AS BIGINT) AS event_id, CASE event_type WHEN 'click' THEN k = 7 WHEN 'view' THEN k = 7 WHEN 'error' THEN FALSE ELSE TRUE END AS correct FROM ev""",
)
def open_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Open answers whose result stands after a key phrase, in a number with more digits, nowhere, or as a word."""
    k = F.col("k").cast("string")
    said = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("I counted. So the number of cups is "), k, F.lit(".")))
        .when(F.col("event_type") == "view", F.concat(F.lit("x = 3\nthus y = "), k, F.lit(".000")))
        .when(F.col("event_type") == "error", F.lit("API Error"))
        .otherwise(F.lit("Therefore the animal is a red fox"))
    )
    return told_events(spark, folder).select(big("event_id"), P.open_answer_correct(said, F.array(F.lit("7"), F.lit("Fox"))).alias("correct"))


@query(
    "pooled_vectors",
    f"""WITH {SCORED}, c AS (SELECT label, vec_id // 8 AS node, p, avg(v[p]) AS x FROM (SELECT label, vec_id, v, unnest(range(1, len(v) + 1)) AS p FROM emb) GROUP BY ALL),
m AS (SELECT label, node, list(x ORDER BY p) AS c FROM c GROUP BY label, node), u AS (SELECT label, node, {unit('c')} AS c FROM m)
SELECT CAST(label AS BIGINT) AS label, CAST(node AS BIGINT) AS node_id, round(c[1], 6) + 0.0 AS first, round(list_sum(c), 6) + 0.0 AS total FROM u""",
)
def pooled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """One direction per node of up to eight vectors."""
    rows = table(spark, folder, "embeddings").groupBy("label", F.expr("vec_id div 8").alias("node_id")).agg(
        V.mean_pool(F.collect_list(V.as_doubles(F.col("embedding")))).alias("v")
    )
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return rows.select(big("label"), big("node_id"), (F.round(F.get("v", 0), 6) + 0.0).alias("first"), (F.round(total, 6) + 0.0).alias("total"))


@query(
    "vector_confidence",
    f"""WITH {SCORED} SELECT CAST(label AS BIGINT) AS label, CAST(vec_id AS BIGINT) AS vec_id, round(least(greatest((rel + 1) / 2, 0.0), 1.0), 4) + 0.0 AS confidence FROM scored""",
)
def vector_confidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_vectors(spark, folder)
    return rows.select(big("label"), big("vec_id"), (V.confidence(F.col("relevance")) + 0.0).alias("confidence"))


@query(
    "entity_search",
    f"""WITH {SCORED}, p AS (SELECT a.label, a.vec_id // 8 AS node, round(avg(list_dot_product(a.v, b.v)), 9) AS s FROM unitv a JOIN unitv b ON a.label = b.label AND b.vec_id % 10 = 0 GROUP BY 1, 2)
SELECT CAST(label AS BIGINT) AS label, CAST(node AS BIGINT) AS node_id, CAST(row_number() OVER (PARTITION BY label ORDER BY s DESC, node) AS BIGINT) AS rank FROM p WHERE s >= 0.01""",
)
def entity_search(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of eight vectors against all query vectors of their label."""
    rows = table(spark, folder, "embeddings").select("label", "vec_id", "embedding", F.expr("vec_id div 8").alias("node_id"))
    found = scoring.search_entities(rows, rows.filter("vec_id % 10 = 0"), ["label"], "node_id", "embedding", 0.01)
    return found.select(big("label"), big("node_id"), big("rank"))


@query(
    "valid_edges",
    f"""WITH {_UG} SELECT CAST(e.user_id AS BIGINT) AS user_id, CAST(count(*) AS BIGINT) AS edges, CAST(sum(dst) AS BIGINT) AS ends FROM e
JOIN n a ON a.user_id = e.user_id AND a.event_id = e.src JOIN n b ON b.user_id = e.user_id AND b.event_id = e.dst
WHERE NOT (a.type = b.type AND a.type IN ('episodic', 'semantic')) GROUP BY e.user_id""",
)
def valid_edges(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = user_graphs(spark, folder)
    kept = G.valid_edges(edges, nodes, ["user_id"])
    return kept.groupBy(big("user_id")).agg(F.count("*").alias("edges"), F.sum("dst").cast("bigint").alias("ends"))


@query(
    "related_nodes",
    f"""WITH {EV}, al AS (SELECT DISTINCT user_id % 40 AS c, 'voice_' || user_id AS tag FROM ev UNION SELECT DISTINCT k % 40, 'face_' || k FROM ev WHERE k < 50),
r AS (SELECT event_id, tag FROM ev JOIN al ON al.c = user_id % 40 UNION SELECT event_id, 'face_' || k FROM ev WHERE k < 50)
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(count(*) AS BIGINT) AS nodes, min(tag) AS first_tag, max(tag) AS last_tag FROM r GROUP BY event_id""",
)
def related_nodes(spark: SparkSession, folder: str) -> DataFrame:
    ev = told_events(spark, folder)
    tag = lambda kind, c: F.concat(F.lit(f"{kind}_"), c.cast("string"))
    members = ev.select("graph", tag("character", F.col("user_id") % 40).alias("character_tag"), tag("voice", F.col("user_id")).alias("tag")).unionByName(
        ev.filter("k < 50").select("graph", tag("character", F.col("k") % 40).alias("character_tag"), tag("face", F.col("k")).alias("tag"))
    )
    text = F.concat(F.lit("What did <"), tag("character", F.col("user_id") % 40), F.lit("> show <"), tag("face", F.col("k")), F.lit(">?"))
    asked, nodes = I.related_nodes(ev.select("graph", "event_id", text.alias("question")), members.distinct(), ["graph"], ["event_id"], "question")
    counted = nodes.groupBy("graph", "asked").agg(F.count("*").alias("nodes"), F.min("tag").alias("first_tag"), F.max("tag").alias("last_tag"))
    return asked.join(broadcast_when_small(counted, 512), ["graph", "asked"]).select(big("event_id"), "nodes", "first_tag", "last_tag")


@query(
    "clip_inspection",
    f"""WITH {CAP}, d AS (SELECT CAST(day(day) AS BIGINT) AS clip_id, user_id, k FROM ev)
SELECT clip_id, CAST(count(*) AS BIGINT) AS texts, CAST(count(DISTINCT k) AS BIGINT) AS faces, CAST(count(DISTINCT user_id) AS BIGINT) AS voices FROM d GROUP BY clip_id""",
)
def clip_inspection(spark: SparkSession, folder: str) -> DataFrame:
    days = told_events(spark, folder).select("event_id", F.dayofmonth("day").alias("clip_id"))
    found = I.clip_inspection(captions(spark, folder).join(days, "event_id"), ["graph"], "clip_id", "text")
    return found.select(big("clip_id"), big("texts"), big("faces"), big("voices"))


@query(
    "array_annotations",
    """SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, md5(text) AS text, CAST(length(text) AS DOUBLE) / 4 AS quarter FROM conversations""",
)
def array_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Turns written as JSON arrays, a file for each 64 conversations, and read back element by element."""
    turns = table(spark, folder, "conversations").withColumn("about", F.struct("role", (F.length("text") / 4).alias("quarter")))
    items = F.collect_list(F.to_json(F.struct("conv_id", "turn", "text", "about")))
    arrays = turns.groupBy(F.expr("conv_id div 64").alias("part")).agg(F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit("\n]")).alias("value"))
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/arrays-{uuid.uuid4().hex}"
    arrays.select("part", "value").write.partitionBy("part").text(path)
    rows = elements.json_table(spark, f"{path}/*")
    return rows.select(big("conv_id"), big("turn"), "about.role", F.md5(F.col("text").cast("binary")).alias("text"), F.col("about.quarter").cast("double").alias("quarter"))


@query("identity_hints")
def identity_hints(spark: SparkSession, folder: str) -> DataFrame:
    """First words of the documents of a language as names of fifty characters, asked for by the first words of the test items."""
    first = F.regexp_extract("text", "[A-Za-z]+", 0)
    docs = text_table(spark, folder, "documents").select("lang", "doc_id", first.alias("name"))
    members = docs.select("lang", F.col("doc_id").alias("node_id"), (F.col("doc_id") % 50).alias("character"))
    named = hints.character_names(docs.withColumnRenamed("doc_id", "voice"), members, ["lang"])
    asked = table(spark, folder, "benchmark").select(F.lit("en").alias("lang"), "item_id", first.alias("name"))
    found = hints.identity_hints(asked, named, ["lang"], ["item_id"], "name")
    return found.select(big("item_id"), big("character"), "candidate", digits("score"), big("rank"))
