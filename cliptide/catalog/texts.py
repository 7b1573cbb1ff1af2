"""Lexical ranking, tokenising and answer scoring over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.catalog.registry import big, digits, query, table, text_table
from cliptide.functions import text as X
from cliptide.functions import vectors as V
from cliptide.operators import lexical

_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def sql_content(column: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), "
        f"lambda w: len(w) > 1 AND NOT list_contains([{_STOPS}], w))"
    )


def sql_normal(column: str) -> str:
    """Answer form: the oracle splits on blanks instead of using word boundaries."""
    plain = f"regexp_replace(lower(replace({column}, ',', '')), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return (
        f"array_to_string(list_filter(string_split(trim(regexp_replace({plain}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' '), "
        "lambda w: w <> '' AND NOT list_contains(['a', 'an', 'the', 'and'], w)), ' ')"
    )


def sql_answer_tokens(column: str) -> str:
    return f"regexp_extract_all({sql_normal(column)}, '[a-z0-9]+')"


def turn_questions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Each conversation's last turn is its question, all earlier turns are its memory."""
    turns = text_table(spark, folder, "conversations")
    last = turns.groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"), F.max_by("text", "turn").alias("question")
    )
    memory = turns.join(last.select("conv_id", "last_turn"), "conv_id").filter("turn < last_turn")
    docs = memory.select("conv_id", "turn", "role", "text", X.content_tokens(F.col("text")).alias("tokens"))
    questions = last.select("conv_id", "question", X.content_tokens(F.col("question")).alias("tokens"))
    return docs, questions


TURNS = f"""
lastt AS (SELECT conv_id, max(turn) AS lt, arg_max(text, turn) AS question FROM conversations GROUP BY conv_id),
docs AS (SELECT c.conv_id, c.turn, c.role, c.text, question FROM conversations c JOIN lastt l ON c.conv_id = l.conv_id AND c.turn < l.lt),
dt AS (SELECT conv_id, turn, t, count(*) AS tf, sum(count(*)) OVER (PARTITION BY conv_id, turn) AS tot FROM
       (SELECT conv_id, turn, unnest({sql_content('text')}) AS t FROM docs) GROUP BY conv_id, turn, t),
nd AS (SELECT conv_id, count(*) AS n FROM docs GROUP BY conv_id),
dfq AS (SELECT conv_id, t, count(*) AS df FROM dt GROUP BY conv_id, t),
qt AS (SELECT q.conv_id, q.t, q.tf / q.tot * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) AS qw FROM
       (SELECT conv_id, t, count(*) AS tf, sum(count(*)) OVER (PARTITION BY conv_id) AS tot FROM
        (SELECT conv_id, unnest({sql_content('question')}) AS t FROM lastt) GROUP BY conv_id, t) q
       JOIN nd USING (conv_id) LEFT JOIN dfq d ON d.conv_id = q.conv_id AND d.t = q.t),
qn AS (SELECT conv_id, sqrt(sum(qw * qw)) AS qn FROM qt GROUP BY conv_id),
dw AS (SELECT dt.conv_id, dt.turn, dt.t, tf / tot * (ln((n + 1) / (df + 1)) + 1) AS w FROM dt JOIN nd USING (conv_id)
       JOIN dfq ON dfq.conv_id = dt.conv_id AND dfq.t = dt.t),
dn AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS dn FROM dw GROUP BY conv_id, turn),
hit AS (SELECT dw.conv_id, dw.turn, sum(w * qw) AS h FROM dw JOIN qt ON qt.conv_id = dw.conv_id AND qt.t = dw.t GROUP BY dw.conv_id, dw.turn),
tfidf AS (SELECT docs.conv_id, docs.turn, docs.text, docs.question, coalesce(round(h / dn / qn, 9), 0.0) + 0.0 AS score FROM docs
          LEFT JOIN dn ON dn.conv_id = docs.conv_id AND dn.turn = docs.turn LEFT JOIN qn ON qn.conv_id = docs.conv_id
          LEFT JOIN hit ON hit.conv_id = docs.conv_id AND hit.turn = docs.turn)
"""


@query(
    "tfidf_rank",
    f"""WITH {TURNS} SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, round(score, 6) + 0.0 AS score,
CAST(row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS BIGINT) AS rank FROM tfidf""",
)
def tfidf_rank(spark: SparkSession, folder: str) -> DataFrame:
    docs, questions = turn_questions(spark, folder)
    scored = lexical.tfidf_scores(docs, questions, ["conv_id"], "turn", "tokens")
    ranked = lexical.ranked_all(scored, ["conv_id"], F.col("turn").cast("double"), "turn")
    return ranked.select(big("conv_id"), big("turn"), digits("score"), big("rank"))


def _profile_sql(column: str) -> str:
    return (
        f"list_transform(range(97, 123), lambda c: CAST(len(lower({column})) - len(replace(lower({column}), chr(CAST(c AS INTEGER)), '')) AS DOUBLE))"
    )


@query(
    "hybrid_rank",
    f"""WITH {TURNS},
pv AS (SELECT conv_id, turn, score AS sparse, {_profile_sql('text')} AS dv, {_profile_sql('question')} AS qv FROM tfidf),
ds AS (SELECT conv_id, turn, sparse, CASE WHEN list_dot_product(dv, dv) <= 0 OR list_dot_product(qv, qv) <= 0 THEN 0.0 ELSE
  round(list_dot_product(dv, qv) / (sqrt(list_dot_product(dv, dv)) * sqrt(list_dot_product(qv, qv))), 9) END AS dense FROM pv),
mm AS (SELECT *, min(dense) OVER w AS d0, max(dense) OVER w AS d1, min(sparse) OVER w AS s0, max(sparse) OVER w AS s1 FROM ds
       WINDOW w AS (PARTITION BY conv_id)),
bl AS (SELECT conv_id, turn, round(0.7 * ((dense - d0) / greatest(d1 - d0, 1e-12)) + 0.3 * ((sparse - s0) / greatest(s1 - s0, 1e-12)), 9) + 0.0
       AS score FROM mm)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, round(score, 6) + 0.0 AS score,
CAST(row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS BIGINT) AS rank FROM bl""",
)
def hybrid_rank(spark: SparkSession, folder: str) -> DataFrame:
    docs, questions = turn_questions(spark, folder)
    sparse = lexical.tfidf_scores(docs, questions, ["conv_id"], "turn", "tokens")
    sparse = docs.select("conv_id", "turn", "text").join(sparse, ["conv_id", "turn"])
    profile = questions.select("conv_id", X.letter_profile(F.col("question")).alias("query_vector"))
    both = sparse.withColumnRenamed("score", "sparse").join(profile, "conv_id")
    dense = both.withColumn(
        "dense",
        F.round(V.cosine(X.letter_profile(F.col("text")), F.col("query_vector")), V.SCORE_DIGITS),
    )
    blended = lexical.hybrid_scores(dense, ["conv_id"], "dense", "sparse", 0.7)
    ranked = lexical.ranked_all(blended, ["conv_id"], F.col("turn").cast("double"), "turn")
    return ranked.select(big("conv_id"), big("turn"), digits("score"), big("rank"))


@query(
    "bm25_rank",
    f"""WITH d AS (SELECT doc_id, {sql_answer_tokens('text')} AS tk FROM documents),
dl AS (SELECT doc_id, len(tk) AS l FROM d),
dt AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS t FROM d) GROUP BY doc_id, t),
q AS (SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest({sql_answer_tokens('text')}) AS t FROM benchmark) GROUP BY item_id, t),
df AS (SELECT t, count(*) AS df FROM dt GROUP BY t),
st AS (SELECT count(*) AS n, avg(l) AS a FROM dl),
sc AS (SELECT q.item_id, dt.doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 9) AS s
       FROM q JOIN dt ON dt.t = q.t JOIN df ON df.t = q.t JOIN dl ON dl.doc_id = dt.doc_id, st GROUP BY q.item_id, dt.doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id DESC) AS r FROM sc WHERE s > 0)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(doc_id AS BIGINT) AS doc_id, round(s, 6) + 0.0 AS score, CAST(r AS BIGINT) AS rank FROM rk WHERE r <= 10""",
)
def bm25_rank(spark: SparkSession, folder: str) -> DataFrame:
    docs = text_table(spark, folder, "documents").select("doc_id", X.answer_tokens(F.col("text")).alias("tokens"))
    items = table(spark, folder, "benchmark").select("item_id", X.answer_tokens(F.col("text")).alias("tokens"))
    best = lexical.bm25_top(docs, items, "doc_id", "item_id", "tokens", 10)
    return best.select(big("item_id"), big("doc_id"), digits("score"), big("rank"))


@query(
    "token_f1",
    f"""WITH p AS (SELECT conv_id, turn, {sql_answer_tokens('text')} AS a, lag({sql_answer_tokens('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b
FROM conversations),
r AS (SELECT conv_id, turn, a, b FROM p WHERE b IS NOT NULL),
ca AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS t FROM r) GROUP BY ALL),
cb AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS t FROM r) GROUP BY ALL),
cm AS (SELECT ca.conv_id, ca.turn, sum(least(ca.n, cb.n)) AS c FROM ca JOIN cb USING (conv_id, turn, t) GROUP BY ca.conv_id, ca.turn)
SELECT CAST(r.conv_id AS BIGINT) AS conv_id, CAST(r.turn AS BIGINT) AS turn, round(CASE WHEN coalesce(c, 0) = 0 THEN 0.0 ELSE
  2 * (c / len(a)) * (c / len(b)) / (c / len(a) + c / len(b)) END, 6) + 0.0 AS f1 FROM r LEFT JOIN cm ON cm.conv_id = r.conv_id AND cm.turn = r.turn""",
)
def token_f1(spark: SparkSession, folder: str) -> DataFrame:
    turns = text_table(spark, folder, "conversations").select("conv_id", "turn", "text")
    previous = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    pairs = turns.join(previous, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        X.answer_tokens(F.col("text")).alias("predicted"),
        X.answer_tokens(F.col("gold")).alias("expected"),
    )
    scored = lexical.token_f1(pairs, ["conv_id", "turn"], "predicted", "expected")
    return scored.select(big("conv_id"), big("turn"), digits("f1"))


@query(
    "stem_vocabulary",
    """WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)
SELECT CASE WHEN w LIKE '%ing' AND len(w) > 6 THEN left(w, len(w) - 3) WHEN w LIKE '%ed' AND len(w) > 5 THEN left(w, len(w) - 2)
  WHEN w LIKE '%es' AND len(w) > 5 THEN left(w, len(w) - 2) WHEN w LIKE '%s' AND len(w) > 4 THEN left(w, len(w) - 1) ELSE w END AS stem,
  CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1""",
)
def stem_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    words = text_table(spark, folder, "documents").select(F.explode(X.words(F.col("text"))).alias("word"))
    return words.groupBy(X.stem(F.col("word")).alias("stem")).agg(F.count("*").alias("n"))


@query(
    "answer_normalize",
    f"SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, {sql_normal('text')} AS answer FROM conversations",
)
def answer_normalize(spark: SparkSession, folder: str) -> DataFrame:
    turns = text_table(spark, folder, "conversations")
    return turns.select(big("conv_id"), big("turn"), X.normalize_answer(F.col("text")).alias("answer"))
