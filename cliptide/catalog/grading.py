"""Evaluation queries: two answer rules graded against the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.catalog.registry import big, digits, query, table
from cliptide.operators import evaluation as E
from cliptide.operators import metrics as M


def graded(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with two rule-based predictions and their correctness."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, folder, "labels").join(docs, "doc_id")
    return rows.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        "quality",
        "toxic",
        ((F.col("n_chars") > 600).cast("int") == F.col("quality")).alias("hit"),
        ((F.col("n_chars") % 3 != 0).cast("int") == F.col("quality")).alias("other"),
        (F.col("n_chars") % 7 + 2).alias("k"),
        F.when(F.col("n_chars") > 2000, "long").when(F.col("n_chars") > 500, "medium").otherwise("short").alias("duration"),
    )


GRADED = """g AS (SELECT l.doc_id, lang, source, n_chars, quality, toxic, CAST(n_chars > 600 AS INT) = quality AS hit,
CAST(n_chars % 3 <> 0 AS INT) = quality AS other, n_chars % 7 + 2 AS k,
CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars > 500 THEN 'medium' ELSE 'short' END AS duration
FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
RATES = "CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (hit) AS BIGINT) AS correct, round(avg(CAST(hit AS INT)), 6) + 0.0 AS accuracy"


def rates(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, big("total"), big("correct"), digits("accuracy"))


@query(
    "accuracy_summary",
    f"WITH {GRADED} SELECT {RATES}, round(avg(coalesce(k, 0)), 6) + 0.0 AS mean_selected FROM g",
)
def accuracy_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = E.accuracy(graded(spark, folder), "hit", "k")
    return out.select(big("total"), big("correct"), digits("accuracy"), digits("mean_selected"))


@query(
    "accuracy_rollup",
    f"""WITH {GRADED} SELECT coalesce(duration, '(all)') AS duration, coalesce(lang, '(all)') AS lang, coalesce(source, '(all)') AS source, {RATES}
FROM g GROUP BY GROUPING SETS ((duration, lang, source), (duration), (lang), (source), ())""",
)
def accuracy_rollup(spark: SparkSession, folder: str) -> DataFrame:
    levels = [["duration", "lang", "source"], ["duration"], ["lang"], ["source"], []]
    return rates(E.rollup_levels(graded(spark, folder), levels, "hit"), "duration", "lang", "source")


@query(
    "accuracy_cube",
    f"""WITH {GRADED} SELECT coalesce(lang, '(all)') AS lang, coalesce(CAST(toxic AS VARCHAR), '(all)') AS toxic, {RATES}
FROM g GROUP BY CUBE (lang, toxic)""",
)
def accuracy_cube(spark: SparkSession, folder: str) -> DataFrame:
    levels = [["lang", "toxic"], ["lang"], ["toxic"], []]
    return rates(E.rollup_levels(graded(spark, folder), levels, "hit"), "lang", "toxic")


@query(
    "accuracy_substring",
    f"""WITH {GRADED}, n AS (SELECT unnest(['src1', 'src2', 'en', 'fr', 'long', 'short']) AS name)
SELECT name, {RATES} FROM g JOIN n ON contains(duration || '_' || lang || '_' || source, name) GROUP BY name""",
)
def accuracy_substring(spark: SparkSession, folder: str) -> DataFrame:
    names = ["src1", "src2", "en", "fr", "long", "short"]
    return rates(E.substring_rollup(graded(spark, folder), ["duration", "lang", "source"], names, "hit"), "name")


@query(
    "multi_type_accuracy",
    f"""WITH {GRADED}, t AS (SELECT *, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN [lang] ELSE [lang, duration] END AS types FROM g),
f AS (SELECT 'type' AS level, unnest(coalesce(types, ['(none)'])) AS name, hit, k FROM t
UNION ALL SELECT 'video', source, hit, k FROM t UNION ALL SELECT 'all', '(all)', hit, k FROM t)
SELECT level, name, {RATES}, round(avg(k), 6) + 0.0 AS mean_selected FROM f GROUP BY level, name""",
)
def multi_type_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    rows = graded(spark, folder)
    types = F.when(F.col("k") % 3 == 1, F.array("lang")).when(F.col("k") % 3 == 2, F.array("lang", "duration"))
    out = E.by_types_and_video(rows.withColumn("types", types), "types", "source", "hit", "k")
    return out.select("level", "name", big("total"), big("correct"), digits("accuracy"), digits("mean_selected"))


@query(
    "double_counted_accuracy",
    f"""WITH {GRADED}, f AS (SELECT duration AS name, hit FROM g UNION ALL SELECT source, hit FROM g)
SELECT coalesce(name, 'Overall') AS name, {RATES} FROM f GROUP BY GROUPING SETS ((name), ())""",
)
def double_counted(spark: SparkSession, folder: str) -> DataFrame:
    return rates(E.per_subset_accuracy(graded(spark, folder), ["duration", "source"], "hit"), "name")


_FIXED = ["src0", "src1", "src2", "src3", "src4", "no_such_task"]


@query(
    "macro_mean_fixed",
    f"""WITH {GRADED}, w AS (SELECT unnest({_FIXED}) AS name), r AS (SELECT w.name, count(g.doc_id) AS total, count(*) FILTER (hit) AS correct,
coalesce(100.0 * count(*) FILTER (hit) / nullif(count(g.doc_id), 0), 0.0) AS percent FROM w LEFT JOIN g ON g.source = w.name GROUP BY w.name),
a AS (SELECT name, total, correct, percent FROM r UNION ALL SELECT '(micro)', sum(total), sum(correct), 100.0 * sum(correct) / sum(total) FROM r
UNION ALL SELECT '(macro)', sum(total), sum(correct), avg(percent) FROM r)
SELECT name, CAST(total AS BIGINT) AS total, CAST(correct AS BIGINT) AS correct, round(percent, 6) + 0.0 AS percent FROM a""",
)
def macro_mean_fixed(spark: SparkSession, folder: str) -> DataFrame:
    out = E.macro_accuracy(graded(spark, folder), "source", "hit", _FIXED)
    return out.select("name", big("total"), big("correct"), digits("percent"))


@query(
    "macro_mean_rounded",
    f"""WITH {GRADED}, r AS (SELECT source AS name, count(*) AS total, count(*) FILTER (hit) AS correct,
round(100.0 * count(*) FILTER (hit) / count(*), 1) AS percent FROM g GROUP BY source),
a AS (SELECT name, total, correct, percent FROM r UNION ALL SELECT '(micro)', sum(total), sum(correct), 100.0 * sum(correct) / sum(total) FROM r
UNION ALL SELECT '(macro)', sum(total), sum(correct), avg(percent) FROM r)
SELECT name, CAST(total AS BIGINT) AS total, CAST(correct AS BIGINT) AS correct, round(percent, 6) + 0.0 AS percent FROM a""",
)
def macro_mean_rounded(spark: SparkSession, folder: str) -> DataFrame:
    out = E.macro_accuracy(graded(spark, folder), "source", "hit", digits=1)
    return out.select("name", big("total"), big("correct"), digits("percent"))


@query(
    "discipline_scores",
    f"""WITH {GRADED}, w AS (SELECT unnest(['en', 'fr', 'xx']) AS name), r AS (SELECT w.name, count(g.doc_id) AS total, coalesce(avg(k), 0) AS m,
coalesce(100 * avg(CAST(hit AS INT)), 0) AS y FROM w LEFT JOIN g ON g.lang = w.name GROUP BY w.name),
a AS (SELECT * FROM r UNION ALL SELECT '(final)', sum(total), avg(m), avg(y) FROM r)
SELECT name, CAST(total AS BIGINT) AS total, round(m, 6) + 0.0 AS mean_score, round(y, 6) + 0.0 AS yes_rate FROM a""",
)
def discipline_scores(spark: SparkSession, folder: str) -> DataFrame:
    out = E.discipline_scores(graded(spark, folder), "lang", "k", "hit", ["en", "fr", "xx"])
    return out.select("name", big("total"), digits("mean_score"), digits("yes_rate"))


@query(
    "run_summary",
    f"""WITH {GRADED}, kc AS (SELECT duration, k, count(*) AS n FROM g GROUP BY ALL), sc AS (SELECT duration, lang, count(*) AS n FROM g GROUP BY ALL)
SELECT g.duration AS run, CAST(count(*) AS BIGINT) AS logs, round(avg(k), 6) + 0.0 AS mean_k, round(100.0 * avg(CAST(hit AS INT)), 6) + 0.0 AS accuracy,
(SELECT string_agg(k || '=' || n, ';' ORDER BY CAST(k AS VARCHAR)) FROM kc WHERE kc.duration = g.duration) AS k_counts,
(SELECT string_agg(lang || '=' || n, ';' ORDER BY lang) FROM sc WHERE sc.duration = g.duration) AS selectors FROM g GROUP BY g.duration""",
)
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = E.run_summary(graded(spark, folder), "duration", "k", "lang", "hit")

    def text(name: str):
        parts = F.transform(
            F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
        )
        return F.array_join(parts, ";").alias(name)

    return out.select(
        F.col("duration").alias("run"), big("logs"), digits("mean_k"), digits("accuracy"), text("k_counts"), text("selectors")
    )


@query(
    "paired_sign_test",
    f"""WITH {GRADED}, c AS (SELECT count(*) AS common, count(*) FILTER (hit AND other) AS bo, count(*) FILTER (hit AND NOT other) AS w,
count(*) FILTER (NOT hit AND other) AS l FROM g)
SELECT CAST(common AS BIGINT) AS common, CAST(bo AS BIGINT) AS both_correct, CAST(w AS BIGINT) AS target_only, CAST(l AS BIGINT) AS baseline_only,
CAST(common - bo - w - l AS BIGINT) AS neither, CAST(w - l AS BIGINT) AS net_wins, round(100.0 * (w - l) / common, 6) + 0.0 AS delta_accuracy,
round(least(1.0, 2.0 * list_sum(list_transform(range(0, least(w, l) + 1), lambda i: exp(lgamma(w + l + 1.0) - lgamma(i + 1.0) - lgamma(w + l - i + 1.0)
 - (w + l) * ln(2.0))))), 6) + 0.0 AS sign_test_p FROM c""",
)
def paired_sign_test(spark: SparkSession, folder: str) -> DataFrame:
    rows = graded(spark, folder)
    target = rows.select("doc_id", "hit", "k")
    baseline = rows.select("doc_id", F.col("other").alias("hit"), "k")
    out = E.paired_comparison(target, baseline, "doc_id", "hit", "k")
    return out.select(
        big("common"),
        F.col("both").alias("both_correct"),
        big("target_only"),
        big("baseline_only"),
        big("neither"),
        big("net_wins"),
        digits("delta_accuracy"),
        digits("sign_test_p"),
    )


@query(
    "compare_runs",
    f"""WITH {GRADED}, r AS (SELECT 'base' AS run, doc_id, hit AS ok FROM g UNION ALL SELECT 'other', doc_id, other FROM g WHERE toxic = 0
UNION ALL SELECT 'all_one', doc_id, quality = 1 FROM g)
SELECT a.run, CAST(count(*) AS BIGINT) AS common, round(100.0 * avg(CAST(a.ok AS INT)), 6) + 0.0 AS accuracy,
round(100.0 * avg(CAST(b.ok AS INT)), 6) + 0.0 AS baseline_accuracy, CAST(count(*) FILTER (a.ok AND NOT b.ok) AS BIGINT) AS gained,
CAST(count(*) FILTER (b.ok AND NOT a.ok) AS BIGINT) AS lost FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.run = 'base' GROUP BY a.run""",
)
def compare_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = graded(spark, folder)
    runs = (
        rows.select(F.lit("base").alias("run"), "doc_id", F.col("hit").alias("ok"))
        .unionByName(rows.filter("toxic = 0").select(F.lit("other").alias("run"), "doc_id", F.col("other").alias("ok")))
        .unionByName(rows.select(F.lit("all_one").alias("run"), "doc_id", (F.col("quality") == 1).alias("ok")))
    )
    out = E.compare_runs(runs, "run", "doc_id", "ok", "base")
    return out.select("run", big("common"), digits("accuracy"), digits("baseline_accuracy"), big("gained"), big("lost"))


ROC = f"""{GRADED}, c AS (SELECT n_chars AS s, sum(quality) AS t, sum(1 - quality) AS i FROM g GROUP BY n_chars),
pt AS (SELECT s, t, i, sum(t) OVER (ORDER BY s) / sum(t) OVER () AS fnr, 1 - sum(i) OVER (ORDER BY s) / sum(i) OVER () AS fpr FROM c)"""
BAND = 1024.0


@query(
    "roc_points",
    f"WITH {ROC} SELECT CAST(s AS BIGINT) AS score, round(fnr, 6) + 0.0 AS fnr, round(fpr, 6) + 0.0 AS fpr FROM pt",
)
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    points = M.roc_points(graded(spark, folder), "n_chars", "quality", BAND)
    return points.select(big("score"), digits("fnr"), digits("fpr"))


@query(
    "roc_eer",
    f"""WITH {ROC}, a AS (SELECT * FROM pt WHERE round(fnr - fpr, 12) >= 0 ORDER BY s LIMIT 1), b AS (SELECT * FROM pt WHERE round(fnr - fpr, 12) < 0 ORDER BY s DESC LIMIT 1)
SELECT round(a.fnr + (a.fnr - a.fpr) / (b.fpr - a.fpr - (b.fnr - a.fnr)) * (b.fnr - a.fnr), 6) + 0.0 AS eer, CAST(a.s AS BIGINT) AS threshold FROM a, b""",
)
def roc_eer(spark: SparkSession, folder: str) -> DataFrame:
    points = M.roc_points(graded(spark, folder), "n_chars", "quality", BAND)
    return M.equal_error_rate(points).select(digits("eer"), big("threshold"))


@query(
    "detection_cost",
    f"WITH {ROC} SELECT round(min(fnr * 0.01 + fpr * 0.99), 6) + 0.0 AS min_cost, round(min(fnr * 0.01 + fpr * 0.99) / 0.01, 6) + 0.0 AS normalised_cost FROM pt",
)
def detection_cost(spark: SparkSession, folder: str) -> DataFrame:
    points = M.roc_points(graded(spark, folder), "n_chars", "quality", BAND)
    return M.detection_cost(points, 0.01).select(digits("min_cost"), digits("normalised_cost"))


@query(
    "binned_roc",
    f"""WITH {GRADED}, e AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM g),
b AS (SELECT least(63, CAST(floor((n_chars - lo) * 64 / (hi - lo)) AS BIGINT)) AS bin, sum(quality) AS t, sum(1 - quality) AS i FROM g, e GROUP BY 1),
f AS (SELECT r.bin, coalesce(t, 0) AS t, coalesce(i, 0) AS i FROM (SELECT unnest(range(0, 64)) AS bin) r LEFT JOIN b USING (bin))
SELECT CAST(bin AS BIGINT) AS bin, round(sum(t) OVER (ORDER BY bin) / sum(t) OVER (), 6) + 0.0 AS fnr, round(1 - sum(i) OVER (ORDER BY bin) / sum(i) OVER (), 6) + 0.0 AS fpr FROM f""",
)
def binned_roc(spark: SparkSession, folder: str) -> DataFrame:
    return M.binned_roc(graded(spark, folder), "n_chars", "quality", 64).select(big("bin"), digits("fnr"), digits("fpr"))


@query(
    "equalised_eer",
    f"""WITH {GRADED}, n AS (SELECT lang, quality, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT quality, max(n) AS m FROM n GROUP BY quality),
w AS (SELECT g.*, m / n AS w FROM g JOIN n ON n.lang = g.lang AND n.quality = g.quality JOIN m ON m.quality = g.quality),
c AS (SELECT n_chars AS s, sum(quality * w) AS t, sum((1 - quality) * w) AS i FROM w GROUP BY n_chars),
pt AS (SELECT s, sum(t) OVER (ORDER BY s) / sum(t) OVER () AS fnr, 1 - sum(i) OVER (ORDER BY s) / sum(i) OVER () AS fpr FROM c),
a AS (SELECT * FROM pt WHERE round(fnr - fpr, 12) >= 0 ORDER BY s LIMIT 1), b AS (SELECT * FROM pt WHERE round(fnr - fpr, 12) < 0 ORDER BY s DESC LIMIT 1)
SELECT round(a.fnr + (a.fnr - a.fpr) / (b.fpr - a.fpr - (b.fnr - a.fnr)) * (b.fnr - a.fnr), 6) + 0.0 AS eer, CAST(a.s AS BIGINT) AS threshold FROM a, b""",
)
def equalised_eer(spark: SparkSession, folder: str) -> DataFrame:
    weighted = M.equalising_weights(graded(spark, folder), "lang", "quality")
    points = M.roc_points(weighted, "n_chars", "quality", BAND, F.col("weight"))
    return M.equal_error_rate(points).select(digits("eer"), big("threshold"))


@query(
    "average_precision",
    f"""WITH {GRADED}, c AS (SELECT n_chars AS s, sum(quality) AS tp, count(*) AS n FROM g GROUP BY n_chars),
p AS (SELECT s, tp, sum(tp) OVER (ORDER BY s DESC) / sum(n) OVER (ORDER BY s DESC) AS pr FROM c),
e AS (SELECT s, tp, max(pr) OVER (ORDER BY s) AS best FROM p) SELECT round(sum(tp * best) / sum(tp), 6) + 0.0 AS average_precision FROM e""",
)
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return M.average_precision(graded(spark, folder), "n_chars", "quality", BAND).select(digits("average_precision"))


@query(
    "value_histogram",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT least(29, CAST(floor((value - lo) * 30 / (hi - lo)) AS BIGINT)) AS bin, CAST(count(*) AS BIGINT) AS n FROM events, e GROUP BY 1""",
)
def value_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return M.value_histogram(table(spark, folder, "events"), "value").select(big("bin"), big("n"))


@query(
    "cosine_histogram",
    """WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda q: q / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
p AS (SELECT round(list_dot_product(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT least(29, CAST(floor((s + 1.0) * 30 / 2.0) AS BIGINT)) AS bin, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1""",
)
def cosine_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return M.cosine_histogram(table(spark, folder, "embeddings"), "vec_id", "embedding").select(big("bin"), big("n"))
