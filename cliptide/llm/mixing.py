"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import WORD, positioned

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and the most copies of any source's words.
SHARE, MOST = 1.5, 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Target words of each source.

    ``sizes`` holds (source, source_size). Sources in code-point order, null last, take ``weights``
    in turn. A source's part is the level times its weight, cut at ``most`` times its size; the level
    is the one at which the parts add up to ``share`` of all words. Sources are ordered by the level
    at which they are cut, so one running sum finds it.
    """
    picks = F.array(*[F.lit(w) for w in weights])
    weighted = positioned(sizes, [F.col("source").asc_nulls_last()]).select(
        "source", "source_size", F.get(picks, (F.col("pos") % len(weights)).cast("int")).alias("weight")
    )
    cut = weighted.withColumn("cap", most * F.col("source_size")).withColumn("cut_at", F.col("cap") / F.col("weight"))
    summed = positioned(cut, [F.col("cut_at"), F.col("source")], {"caps": "cap", "weights": "weight"})
    total = sizes.agg((share * F.coalesce(F.sum("source_size"), F.lit(0))).alias("total"))
    whole = cut.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("whole"))
    row = total.crossJoin(whole)  # one row
    level = F.try_divide(F.col("total") - (F.col("caps") - F.col("cap")), F.col("whole") - (F.col("weights") - F.col("weight")))
    marked = summed.crossJoin(F.broadcast(row)).withColumn("full", F.col("cut_at") <= level)
    rest = marked.agg(
        F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0)).alias("taken"),
        F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))), F.lit(0)).alias("gone"),
    )
    one = rest.crossJoin(row).select(F.try_divide(F.col("total") - F.col("taken"), F.col("whole") - F.col("gone")).alias("level"))
    return marked.crossJoin(F.broadcast(one)).select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).cast("double").alias("target"),
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, keep: list[str] | None = None
) -> DataFrame:
    """Copies of each document in the mix: (doc_id, size, source_size, target, copies, taken, row); row holds the columns ``keep``.

    Within a source the documents stand largest first, ties by id. Each is expected
    ``target / source_size`` times, so the expected copies up to a document are its place times that
    rate; with one offset per source, taken from a digest of its name, a document is emitted once for
    every whole number that the running sum passes. The taken words differ from the target by no
    more than the largest document. Places come from a range sort, so a source of any size is spread
    over many tasks. Null texts and texts without words have size 0 and are never taken in words;
    a null source is a source; repeated rows are documents of their own; an empty table gives none.
    """
    kept = F.struct(*keep) if keep else F.lit(None).cast("int")
    sized = docs.select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), words(F.col("text")).alias("__size"), kept.alias("__row")
    )
    order = [F.col("__source").asc_nulls_last(), F.col("__size").desc(), F.col("__id").asc_nulls_last()]
    placed = positioned(sized, order)
    sources = placed.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"), F.min("pos").alias("first"))
    goals = targets(sources.select("source", "source_size"), weights, share, most).alias("g")
    rates = goals.join(sources.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))).select(
        F.col("g.source").alias("source"), F.col("g.source_size").alias("source_size"), "target", "first",
        F.coalesce(F.try_divide("target", F.col("g.source_size").cast("double")), F.lit(0.0)).alias("rate"),
        (F.conv(F.substring(F.md5(F.coalesce(F.col("g.source"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32).alias("offset"),
    )
    place = (F.col("pos") - F.col("first")).cast("double")
    passed = F.floor(F.col("rate") * (place + 1) + F.col("offset")) - F.floor(F.col("rate") * place + F.col("offset"))
    return (
        placed.join(rates, F.col("__source").eqNullSafe(F.col("source")))
        .withColumn("copies", passed.cast("int"))
        .select(
            F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", "copies",
            (F.col("copies") * F.col("__size")).cast("bigint").alias("taken"),
            F.col("__row").alias("row"),
        )
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 2 * source_size AS cap,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sizes),
ordered AS (
  SELECT *, cap / weight AS cut_at,
         sum(cap) OVER w - cap AS caps, sum(weight) OVER w - weight AS gone
  FROM weighted WINDOW w AS (ORDER BY cap / weight, source NULLS FIRST ROWS UNBOUNDED PRECEDING)),
totals AS (SELECT 1.5::DOUBLE * sum(source_size) AS total, sum(weight) AS whole FROM weighted),
marked AS (SELECT o.*, t.*, cut_at <= (total - caps) / nullif(whole - gone, 0) AS is_full FROM ordered o, totals t),
final_level AS (
  SELECT (any_value(total) - coalesce(sum(cap) FILTER (is_full), 0)) / nullif(any_value(whole) - coalesce(sum(weight) FILTER (is_full), 0), 0) AS level FROM marked),
goals AS (
  SELECT source, source_size,
         CAST(CASE WHEN is_full THEN cap ELSE least(cap, coalesce(level * weight, cap)) END AS DOUBLE) AS target,
         CAST('0x' || substr(md5(coalesce(source, '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS offset_
  FROM marked, final_level),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id NULLS LAST) AS k FROM sized),
counted AS (
  SELECT p.doc_id, p.size, g.source_size, g.target, g.offset_, p.k, coalesce(g.target / nullif(g.source_size, 0)::DOUBLE, 0) AS rate
  FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate * k::DOUBLE + offset_) - floor(rate * (k - 1)::DOUBLE + offset_)) * size AS BIGINT) AS taken
FROM counted
"""
