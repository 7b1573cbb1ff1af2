"""Answer parsing queries over responses built from the conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.catalog.registry import big, digits, query, table, text_table
from cliptide.catalog.texts import sql_answer_tokens
from cliptide.functions import answers as R
from cliptide.functions import text as X
from cliptide.operators import lexical


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn as a model response in one of eight answer styles, around its whole text."""
    turns = text_table(spark, folder, "conversations")
    letter = F.char(F.lit(65) + (F.col("conv_id") + F.col("turn")) % 4)
    other = F.char(F.lit(65) + (F.col("conv_id") + F.col("turn") * 3 + 1) % 4)
    style = (F.col("conv_id") * 7 + F.col("turn")) % 8
    text = F.col("text")
    shaped = (
        F.when(style == 0, F.concat(F.lit("The best answer is "), letter, F.lit(".")))
        .when(style == 1, F.concat(F.lit("("), letter, F.lit(") "), text))
        .when(style == 2, letter)
        .when(style == 3, F.concat(F.lit("Answer: "), letter, F.lit(")")))
        .when(style == 4, text)
        .when(style == 5, F.concat(letter, F.lit(": "), text, F.lit(" not "), other, F.lit(".")))
        .when(style == 6, F.concat(F.lit("Option "), F.lower(letter), F.lit("\n"), text))
        .otherwise(F.concat(F.lit("I think ("), letter, F.lit(") or ("), other, F.lit(")")))
    )
    return turns.select("conv_id", "turn", "role", text, letter.alias("gold"), shaped.alias("response"))


RESP = """lt AS (SELECT conv_id, turn, role, text, chr(CAST(65 + (conv_id + turn) % 4 AS INTEGER)) AS l, chr(CAST(65 + (conv_id + turn * 3 + 1) % 4 AS INTEGER)) AS o,
(conv_id * 7 + turn) % 8 AS st FROM conversations),
rs AS (SELECT conv_id, turn, role, text, l AS gold, CASE st WHEN 0 THEN 'The best answer is ' || l || '.' WHEN 1 THEN '(' || l || ') ' || text WHEN 2 THEN l
WHEN 3 THEN 'Answer: ' || l || ')' WHEN 4 THEN text WHEN 5 THEN l || ': ' || text || ' not ' || o || '.' WHEN 6 THEN 'Option ' || lower(l) || chr(10) || text
ELSE 'I think (' || l || ') or (' || o || ')' END AS response FROM lt)"""

_IDS = "CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn"


def parsed(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(big("conv_id"), big("turn"), *[c.alias(n) for n, c in columns.items()])


@query(
    "option_extract",
    f"""WITH {RESP}, u AS (SELECT *, upper(trim(response, ' ' || chr(9) || chr(10) || chr(13))) AS r FROM rs),
p AS (SELECT *, regexp_extract(r, '^\\s*\\(?([A-D])\\)?(?:[.\\s:]|$)', 1) AS a, regexp_extract(r, '(?:ANSWER|OPTION)\\s*[:=]?\\s*\\(?([A-D])\\)?', 1) AS b FROM u)
SELECT {_IDS}, CASE WHEN a <> '' THEN a ELSE b END AS option, (CASE WHEN a <> '' THEN a ELSE b END) = gold AS correct FROM p""",
)
def option_extract(spark: SparkSession, folder: str) -> DataFrame:
    option = R.extract_option(F.col("response"))
    return parsed(responses(spark, folder), option=option, correct=option == F.col("gold"))


def _strip_sql(newline: str | None) -> str:
    out = "response" if newline is None else f"replace(response, chr(10), '{newline}')"
    for mark in [",", ".", "!", "?", ";", ":", "''"]:
        out = f"trim({out}, '{mark}')"
    return f"' ' || {out} || ' '"


def _found(shape: str) -> dict[str, str]:
    return {c: f"contains(b, '{shape.format(c)}')" for c in "ABCD"}


def _last(shape: str, test: dict[str, str]) -> str:
    """Letter with the last occurrence of its mark; absent marks sort first, ties to the first letter."""
    items = ", ".join(
        f"CASE WHEN {test[c]} THEN {{'p': CASE WHEN contains(b, '{shape.format(c)}') THEN len(b) - strpos(reverse(b), reverse('{shape.format(c)}')) "
        f"- len('{shape.format(c)}') + 2 ELSE 0 END, 'i': {-i}, 'c': '{c}'}} END"
        for i, c in enumerate("ABCD")
    )
    return f"list_max(list_filter([{items}], lambda q: q IS NOT NULL)).c"


def _any(test: dict[str, str]) -> str:
    return "(" + " OR ".join(test.values()) + ")"


_PERIOD, _COLON, _BRACKET, _BLANK = (_found(s) for s in ("{}.", "{}:", "({})", "{} "))
_EITHER = {c: f"({_PERIOD[c]} OR {_COLON[c]})" for c in "ABCD"}


@query(
    "choice_parse",
    f"""WITH {RESP}, t AS (SELECT *, {_strip_sql('')} AS b FROM rs)
SELECT {_IDS}, coalesce(CASE WHEN {_any(_PERIOD)} THEN {_last('{}.', _EITHER)} WHEN {_any(_COLON)} THEN {_last('{}:', _COLON)}
WHEN {_any(_BRACKET)} THEN {_last('({})', _BRACKET)} WHEN {_any(_BLANK)} THEN {_last(' {} ', _BLANK)} END, '') AS choice FROM t""",
)
def choice_parse(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(responses(spark, folder), choice=R.choice_letter(F.col("response")))


@query(
    "choice_parse_exclusive",
    f"""WITH {RESP}, t AS (SELECT *, {_strip_sql('')} AS b FROM rs)
SELECT {_IDS}, coalesce(CASE WHEN {_any(_PERIOD)} THEN {_last('{}.', _PERIOD)} WHEN {_any(_COLON)} THEN {_last('{}:', _COLON)}
WHEN {_any(_BRACKET)} THEN {_last('({})', _BRACKET)} WHEN {_any(_BLANK)} THEN {_last('{} ', _BLANK)} END, '') AS choice FROM t""",
)
def choice_parse_exclusive(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(responses(spark, folder), choice=R.choice_letter(F.col("response"), exclusive=True))


@query(
    "first_letter",
    f"""WITH {RESP} SELECT {_IDS}, regexp_extract(replace(replace(replace(replace(response, 'The best answer is', ''), 'The correct answer is', ''), 'The answer is', ''),
'The answer', ''), '[ABCD]') AS letter, CASE WHEN strpos(response, ')') > 1 THEN response[strpos(response, ')') - 1] ELSE response END AS bracket FROM rs""",
)
def first_letter(spark: SparkSession, folder: str) -> DataFrame:
    r = F.col("response")
    return parsed(responses(spark, folder), letter=R.first_letter(r), bracket=R.letter_before_bracket(r))


@query(
    "route_labels",
    f"""WITH {RESP}, u AS (SELECT *, upper(trim(response, ' ')) AS r, lower(response) AS w FROM rs),
m AS (SELECT *, regexp_extract(r, '\\b([ABC])\\b', 1) AS lone FROM u)
SELECT {_IDS}, CASE WHEN r IN ('A', 'B', 'C') THEN r WHEN st0 <> '' THEN st0 ELSE 'B' END AS route FROM (SELECT *, CASE WHEN lone <> '' THEN lone
WHEN contains(w, 'zero') OR contains(w, 'no retrieval') OR contains(w, 'no-retrieval') OR contains(w, 'none') THEN 'A'
WHEN contains(w, 'single') OR contains(w, 'one-step') OR contains(w, '1-step') OR contains(w, 'one hop') THEN 'B'
WHEN contains(w, 'multi') OR contains(w, 'complex') THEN 'C' ELSE '' END AS st0 FROM m)""",
)
def route_labels(spark: SparkSession, folder: str) -> DataFrame:
    # ASCII letters only around the lone label: the other side reads word boundaries that way
    ascii_only = F.regexp_replace("response", "[^\\x00-\\x7F]", "#")
    return parsed(responses(spark, folder), route=R.route_label(ascii_only))


_MARKERS = " OR ".join(f"contains(w, '{m}')" for m in R.COMPLEX_MARKERS["caption"])


@query(
    "heuristic_route",
    f"""WITH w AS (SELECT item_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS w FROM benchmark)
SELECT CAST(item_id AS BIGINT) AS item_id, CASE WHEN {_MARKERS} THEN 'C' ELSE 'B' END AS route, CAST(CASE WHEN {_MARKERS} THEN 8 ELSE 7 END AS BIGINT) AS target_k FROM w""",
)
def heuristic_route(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark")
    route = R.heuristic_route(F.col("text"), R.COMPLEX_MARKERS["caption"])
    return items.select(
        big("item_id"), route.alias("route"), F.when(route == "C", 8).otherwise(7).cast("bigint").alias("target_k")
    )


@query(
    "agent_actions",
    f"""WITH {RESP}, a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<think>' || text || '</think> Action: [Answer] then Content: ' || response
WHEN turn % 3 = 1 THEN 'Action: [Search]' || chr(10) || 'Content: ' || text ELSE text END AS r FROM rs),
s AS (SELECT *, string_split(r, '</think>')[-1] AS tail FROM a)
SELECT {_IDS}, CASE WHEN regexp_matches(tail, '(?s)Action: \\[(.*)\\].*Content: (.*)') THEN regexp_extract(tail, '(?s)Action: \\[(.*)\\].*Content: (.*)', 1) ELSE 'Search' END AS action,
CASE WHEN regexp_matches(tail, '(?s)Action: \\[(.*)\\].*Content: (.*)') THEN md5(trim(regexp_extract(tail, '(?s)Action: \\[(.*)\\].*Content: (.*)', 2), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) END AS content FROM s""",
)
def agent_actions(spark: SparkSession, folder: str) -> DataFrame:
    rows = responses(spark, folder)
    answered = F.concat(F.lit("<think>"), "text", F.lit("</think> Action: [Answer] then Content: "), "response")
    searched = F.concat(F.lit("Action: [Search]\nContent: "), "text")
    said = F.when(F.col("turn") % 3 == 0, answered).when(F.col("turn") % 3 == 1, searched).otherwise(F.col("text"))
    acted = rows.withColumn("act", R.agent_action(said))
    return parsed(acted, action=F.col("act.action"), content=F.md5(F.col("act.content").cast("binary")))


@query(
    "build_queries",
    """SELECT CAST(o.o_orderkey AS BIGINT) AS o_orderkey, trim(o.o_orderpriority) || chr(10) || string_agg(chr(CAST(64 + r AS INTEGER)) || '. ' || l_returnflag || l_linestatus, chr(10) ORDER BY r) AS question
FROM orders o JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag || l_linestatus) AS r FROM lineitem) l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderpriority""",
)
def build_queries(spark: SparkSession, folder: str) -> DataFrame:
    option = F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("text"))
    options = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(option)), lambda o: o["text"]).alias("options")
    )
    rows = table(spark, folder, "orders").join(options, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(big("o_orderkey"), R.build_query(F.col("o_orderpriority"), F.col("options")).alias("question"))


@query(
    "multi_f1",
    f"""WITH p AS (SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), r AS (SELECT * FROM p WHERE b IS NOT NULL),
pa AS (SELECT conv_id, turn, row_number() OVER () AS i, {sql_answer_tokens('x')} AS t FROM (SELECT conv_id, turn, unnest(list_filter(list_transform(string_split(a, ','), lambda q: trim(q, ' ' || chr(9) || chr(10) || chr(13))), lambda q: q <> '')) AS x FROM r)),
pb AS (SELECT conv_id, turn, row_number() OVER () AS j, {sql_answer_tokens('x')} AS t FROM (SELECT conv_id, turn, unnest(list_filter(list_transform(string_split(b, ','), lambda q: trim(q, ' ' || chr(9) || chr(10) || chr(13))), lambda q: q <> '')) AS x FROM r)),
ca AS (SELECT conv_id, turn, i, k, count(*) AS n FROM (SELECT conv_id, turn, i, unnest(t) AS k FROM pa) GROUP BY ALL),
cb AS (SELECT conv_id, turn, j, k, count(*) AS n FROM (SELECT conv_id, turn, j, unnest(t) AS k FROM pb) GROUP BY ALL),
cm AS (SELECT ca.conv_id, ca.turn, i, j, sum(least(ca.n, cb.n)) AS c FROM ca JOIN cb USING (conv_id, turn, k) GROUP BY ca.conv_id, ca.turn, i, j),
f AS (SELECT pb.conv_id, pb.turn, pb.j, max(CASE WHEN c > 0 THEN 2 * (c / len(pa.t)) * (c / len(pb.t)) / (c / len(pa.t) + c / len(pb.t)) ELSE 0 END) AS f
      FROM pb LEFT JOIN pa ON pa.conv_id = pb.conv_id AND pa.turn = pb.turn LEFT JOIN cm ON cm.conv_id = pb.conv_id AND cm.turn = pb.turn AND cm.j = pb.j AND cm.i = pa.i GROUP BY pb.conv_id, pb.turn, pb.j)
SELECT {_IDS}, round(avg(f), 6) + 0.0 AS f1 FROM f GROUP BY conv_id, turn""",
)
def multi_f1(spark: SparkSession, folder: str) -> DataFrame:
    turns = text_table(spark, folder, "conversations").select("conv_id", "turn", "text")
    previous = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    rows = turns.join(previous, ["conv_id", "turn"])
    return rows.select(
        big("conv_id"), big("turn"), (F.round(lexical.list_f1(F.col("text"), F.col("gold")), 6) + 0.0).alias("f1")
    )


@query(
    "category_f1",
    f"""WITH {RESP}, p AS (SELECT conv_id, turn, turn % 4 + 2 AS category, text, response, {sql_answer_tokens('response')} AS a, {sql_answer_tokens('text')} AS b FROM rs),
ca AS (SELECT conv_id, turn, k, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS k FROM p) GROUP BY ALL),
cb AS (SELECT conv_id, turn, k, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS k FROM p) GROUP BY ALL),
cm AS (SELECT conv_id, turn, sum(least(ca.n, cb.n)) AS c FROM ca JOIN cb USING (conv_id, turn, k) GROUP BY conv_id, turn),
f AS (SELECT p.category, CASE WHEN category = 5 THEN CASE WHEN contains(lower(response), 'no information available') OR contains(lower(response), 'not mentioned') THEN 1.0 ELSE 0.0 END
 WHEN coalesce(c, 0) = 0 THEN 0.0 ELSE 2 * (c / len(a)) * (c / len(b)) / (c / len(a) + c / len(b)) END AS f FROM p LEFT JOIN cm USING (conv_id, turn))
SELECT coalesce(CAST(category AS VARCHAR), '(all)') AS category, CAST(count(*) AS BIGINT) AS total, round(sum(f), 6) + 0.0 AS score, round(avg(f), 6) + 0.0 AS mean_f1
FROM f GROUP BY GROUPING SETS ((category), ())""",
)
def category_f1(spark: SparkSession, folder: str) -> DataFrame:
    rows = responses(spark, folder).withColumn("category", F.col("turn") % 4 + 2)
    keyed = rows.select(
        "conv_id",
        "turn",
        "category",
        "response",
        X.answer_tokens(F.col("response")).alias("predicted"),
        X.answer_tokens(F.col("text")).alias("expected"),
    )
    scored = lexical.token_f1(keyed, ["conv_id", "turn"], "predicted", "expected")
    lowered = F.lower("response")
    phrase = lowered.contains("no information available") | lowered.contains("not mentioned")
    f1 = F.when(F.col("category") == 5, phrase.cast("double")).otherwise(F.col("f1"))
    graded = scored.withColumn("f1", f1).withColumn("category", F.col("category").cast("string"))
    out = graded.groupingSets([[F.col("category")], []], "category").agg(
        F.count("*").alias("total"), F.sum("f1").alias("score"), F.avg("f1").alias("mean_f1")
    )
    return out.select(F.coalesce("category", F.lit("(all)")).alias("category"), big("total"), digits("score"), digits("mean_f1"))


@query(
    "exact_forms",
    f"""WITH {RESP} SELECT {_IDS}, trim(lower(trim(regexp_replace(response, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~ ') AS form FROM rs""",
)
def exact_forms(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(responses(spark, folder), form=R.exact_form(F.col("response")))
