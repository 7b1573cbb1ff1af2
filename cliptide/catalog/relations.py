"""Join, set and lookup queries over the order tables and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.catalog.registry import big, query, table
from cliptide.functions import text as X
from cliptide.functions import times
from cliptide.functions import vectors as V
from cliptide.operators import joins


def customer_memory(spark: SparkSession, folder: str, keep_missing: bool) -> DataFrame:
    """Customers as questions, their orders (by key) as memory clips."""
    questions = table(spark, folder, "customer").select(F.col("c_custkey").alias("video_id"), "c_mktsegment")
    memory = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("video_id"),
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("start"),
    )
    return joins.attach_memory(
        questions, memory, "video_id", "o_orderkey", F.floor(F.col("o_orderkey") / 65536), keep_missing
    )


_MEM = """m AS (SELECT o_custkey AS video_id, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS st,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)"""
for _name, _join, _keep in (("left_default", "LEFT JOIN", True), ("inner_memory", "JOIN", False)):

    def _build(spark: SparkSession, folder: str, keep: bool = _keep) -> DataFrame:
        return customer_memory(spark, folder, keep).select(
            big("video_id"), "c_mktsegment", big("o_orderkey"), "clip_id", "start", "end"
        )

    query(
        _name,
        f"""WITH {_MEM} SELECT CAST(c_custkey AS BIGINT) AS video_id, c_mktsegment, CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(i AS VARCHAR) AS clip_id,
coalesce(st, CASE WHEN i IS NOT NULL THEN CAST(i AS DOUBLE) * 30 END) AS start, CAST(i AS DOUBLE) * 30 + 30 AS "end" FROM customer {_join} m ON m.video_id = c_custkey""",
    )(_build)


@query(
    "priority_lookup",
    """WITH lm AS (SELECT 'id:' || s_suppkey AS key, CASE s_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS label, s_suppkey AS o FROM supplier
UNION ALL SELECT 'question:' || lower(o_orderpriority), CASE WHEN count(*) % 2 = 0 THEN 'A' ELSE 'C' END, 0 FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderpriority),
k AS (SELECT o_orderkey, 0 AS p, 'id:' || o_orderkey AS key FROM orders UNION ALL SELECT o_orderkey, 1, 'id:' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 2, 'question:' || lower(o_orderpriority) FROM orders),
f AS (SELECT o_orderkey, arg_min(label, p) AS label FROM k JOIN lm USING (key) GROUP BY o_orderkey)
SELECT CAST(o.o_orderkey AS BIGINT) AS o_orderkey, coalesce(f.label, 'B') AS label FROM (SELECT DISTINCT o_orderkey FROM orders) o LEFT JOIN f USING (o_orderkey)""",
)
def priority_lookup(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    remainder = F.col("s_nationkey") % 3
    by_id = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.lit(None).cast("string").alias("question"),
        F.when(remainder == 0, "A").when(remainder == 1, "B").otherwise("C").alias("label"),
        F.col("s_suppkey").alias("ord"),
    )
    by_text = (
        orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .groupBy(F.col("o_orderpriority").alias("question"))
        .agg(F.when(F.count("*") % 2 == 0, "A").otherwise("C").alias("label"))
        .select(F.lit(None).cast("bigint").alias("id"), "question", "label", F.lit(0).cast("bigint").alias("ord"))
    )
    labels = joins.label_map(by_id.unionByName(by_text), ["id"], "question", F.col("label"), "ord")
    items = orders.select("o_orderkey", "o_custkey", "o_orderpriority").dropDuplicates(["o_orderkey"])
    keys = [
        F.concat(F.lit("id:"), F.col("o_orderkey").cast("string")),
        F.concat(F.lit("id:"), F.col("o_custkey").cast("string")),
        F.concat(F.lit("question:"), X.text_key(F.col("o_orderpriority"))),
    ]
    found = joins.priority_lookup(items, "o_orderkey", keys, labels, "B")
    return found.select(big("o_orderkey"), "label")


@query(
    "trial_scores",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT CAST(a.vec_id AS BIGINT) AS enrol, CAST(b.vec_id AS BIGINT) AS test, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) + 0.0 AS score,
CAST(a.label = b.label AS INT)::BIGINT AS target FROM (SELECT e.*, label FROM e JOIN embeddings USING (vec_id)) a JOIN (SELECT e.*, label FROM e JOIN embeddings USING (vec_id)) b ON b.vec_id = a.vec_id + 1""",
)
def trial_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    labels = rows.select(F.col("vec_id").alias("test"), F.col("label").alias("test_label"))
    trials = rows.select(F.col("vec_id").alias("enrol"), (F.col("vec_id") + 1).alias("test"), "label").join(labels, "test")
    scored = joins.trial_scores(trials, rows, "vec_id", "embedding", lambda a, b: F.round(V.cosine(a, b), 6) + 0.0)
    return scored.select(
        big("enrol"), big("test"), "score", (F.col("label") == F.col("test_label")).cast("bigint").alias("target")
    )


@query(
    "anti_seen",
    """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase')
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(day AS VARCHAR) AS day FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = d.user_id AND s.day = d.day)""",
)
def anti_seen(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type")
    seen = days.filter("event_type = 'purchase'").select("user_id", "day")
    new = days.select("user_id", "day").distinct().join(seen, ["user_id", "day"], "left_anti")
    return new.select(big("user_id"), "day")


@query(
    "semi_new_clips",
    """WITH e AS (SELECT user_id, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
a AS (SELECT DISTINCT user_id, k FROM e WHERE event_type = 'signup' AND value > 200), q AS (SELECT DISTINCT user_id FROM a)
SELECT CAST(e.user_id AS BIGINT) AS user_id, CAST(e.event_id AS BIGINT) AS event_id FROM e LEFT JOIN q ON q.user_id = e.user_id LEFT JOIN a ON a.user_id = e.user_id AND a.k = e.k
WHERE q.user_id IS NULL OR a.k IS NOT NULL""",
)
def semi_new_clips(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        "user_id", "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )
    # users without a signup of that value name no entity, so they are not restricted
    allowed = rows.filter("event_type = 'signup' and value > 200").select("user_id", "k")
    kept = joins.restrict_when_any(rows, allowed, ["user_id"], "k")
    return kept.select(big("user_id"), big("event_id"))


@query(
    "backfilled_results",
    """WITH t AS (SELECT doc_id, 'labels' AS origin FROM labels), b AS (SELECT doc_id, 'documents' AS origin FROM documents)
SELECT CAST(doc_id AS BIGINT) AS doc_id, origin FROM (SELECT * FROM t UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM t))""",
)
def backfilled_results(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "labels").select(big("doc_id"), F.lit("labels").alias("origin"))
    backup = table(spark, folder, "documents").select(big("doc_id"), F.lit("documents").alias("origin"))
    return joins.backfill(done, backup, "doc_id")


@query(
    "remaining_items",
    "SELECT CAST(doc_id AS BIGINT) AS doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def remaining_items(spark: SparkSession, folder: str) -> DataFrame:
    left = joins.remaining_items(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")
    return left.select(big("doc_id"), "lang")


@query(
    "token_sets",
    """WITH p AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a, lag(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
s AS (SELECT conv_id, turn, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u, len(a) AS na, len(b) AS nb FROM p WHERE b IS NOT NULL)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(i AS BIGINT) AS shared, CAST(na - i AS BIGINT) AS fresh, i = nb AS superset,
round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE i / u END, 6) + 0.0 AS jaccard FROM s""",
)
def token_sets(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.array_distinct(X.words(F.col("text"))).alias("a"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("a").alias("b"))
    both = turns.join(before, ["conv_id", "turn"])
    shared, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    empty = (F.size("a") == 0) | (F.size("b") == 0)
    return both.select(
        big("conv_id"),
        big("turn"),
        shared.cast("bigint").alias("shared"),
        F.size(F.array_except("a", "b")).cast("bigint").alias("fresh"),
        (shared == F.size("b")).alias("superset"),
        (F.round(F.when(empty, 0.0).otherwise(shared / union), 6) + 0.0).alias("jaccard"),
    )


@query(
    "memory_bank",
    """WITH d AS (SELECT conv_id, 'D' || conv_id || ':' || turn AS doc_id, '[day ' || conv_id || '] ' || role || ': ' || text AS t, 'dialogue' AS source FROM conversations),
o AS (SELECT conv_id, 'O' || conv_id || ':' || role || ':' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS doc_id, '[day ' || conv_id || '] Observation about ' || role || ': ' || text AS t, 'observation' AS source
      FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, 'S' || conv_id AS doc_id, '[day ' || conv_id || '] Session summary: ' || arg_min(text, turn) AS t, 'summary' AS source FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, doc_id, source, md5(t) AS digest FROM (SELECT * FROM d UNION ALL SELECT * FROM o UNION ALL SELECT * FROM s)""",
)
def memory_bank(spark: SparkSession, folder: str) -> DataFrame:
    from cliptide.sources import conversations as C

    turns = table(spark, folder, "conversations")
    session = F.col("conv_id").alias("session")
    when = F.concat(F.lit("day "), F.col("conv_id").cast("string")).alias("date_time")
    dialogue = turns.select(
        session, when, "turn", F.concat(F.lit("D"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("dia_id"),
        F.col("role").alias("speaker"), "text", F.lit(None).cast("string").alias("blip_caption"),
    )
    observations = turns.filter("role = 'assistant'").select(session, when, F.col("role").alias("speaker"), F.col("turn").alias("seq"), "text")
    summaries = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("summary")).select(session, when, "summary")
    bank = C.memory_bank(dialogue, observations, summaries)
    return bank.select(
        F.col("session").cast("bigint").alias("conv_id"), "doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest")
    )


@query(
    "video_ids",
    "SELECT CAST(page_id AS BIGINT) AS page_id, regexp_extract(url, '([^/?#=]+)(?:[?#].*)?$', 1) AS video_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages",
)
def video_ids(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return pages.select(
        big("page_id"),
        F.regexp_extract("url", "([^/?#=]+)(?:[?#].*)?$", 1).alias("video_id"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
    )


@query(
    "page_lines",
    """WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS i FROM pages)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(i AS BIGINT) AS line_no, md5(trim(regexp_replace(line, '<[^>]+>', '', 'g'), ' ')) AS digest FROM l WHERE i % 4 = 2""",
)
def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    from cliptide.sources import subtitles as S

    pages = table(spark, folder, "pages")
    lines = S.every_fourth_line(pages, ["page_id"], "html")
    clean = F.trim(F.regexp_replace("line", "<[^>]+>", ""))
    return lines.select(big("page_id"), big("line_no"), F.md5(clean.cast("binary")).alias("digest"))


@query(
    "hour_offsets",
    """SELECT CAST(user_id AS BIGINT) AS user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS clip, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""",
)
def hour_offsets(spark: SparkSession, folder: str) -> DataFrame:
    clip = F.floor(times.micros(F.col("ts")) / 3_600_000_000)
    return table(spark, folder, "events").groupBy(big("user_id"), clip.alias("clip")).agg(F.count("*").alias("n"))
