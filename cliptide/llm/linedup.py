"""Line dedup: repeated runs of lines by prefix doubling over line-id sequences. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cliptide.llm.common import doc_id, keyed, real_id, tie, written

#: Shortest run of lines that counts as a repeat.
MIN_LINES = 2
KEY = ["id", "tie"]


def sequences(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: (id, tie, seq, line_no, n, h1, h2); ``seq`` counts such lines, ``n`` is their number."""
    cut = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("no"), line.alias("line")))
    filled = F.filter(cut, lambda x: F.trim(x["line"]) != "")
    rows = keyed(docs).select(*KEY, filled.alias("lines")).select(*KEY, F.size("lines").alias("n"), F.posexplode("lines").alias("seq", "x"))
    return rows.select(
        *KEY, "seq", F.col("x.no").alias("line_no"), "n",
        F.xxhash64(F.lit(1), "x.line").alias("h1"), F.xxhash64(F.lit(2), "x.line").alias("h2"),
    ).dropDuplicates([*KEY, "seq"])


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank) of the values of ``keys`` that more than one row has; ranks keep the order of the keys.

    Values are counted before they are ordered, and a range sort deals them out, so a value that very
    many rows share is one row here.
    """
    shared = rows.groupBy(*keys).count().filter("count > 1").select(*keys)
    return written(shared.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()))


def doubled(lines: DataFrame) -> list[DataFrame]:
    """Levels of the suffix order: table k ranks the first 2**k lines of every suffix that shares them.

    Each level pairs a suffix's rank with the rank of the suffix 2**k lines on (-1 past the end of the
    document) and ranks the pairs. A suffix whose pair is its own has its final place and leaves, so the
    levels shrink to what is still repeated; the last level has only suffixes that agree to their end.
    """
    start = written(lines)
    level = written(start.join(named(start, ["h1", "h2"]), ["h1", "h2"]).select(*KEY, "seq", "line_no", "n", "rank"))
    levels, width = [level], 1
    while not level.filter(F.col("seq") + width < F.col("n")).isEmpty():
        beyond = level.select(*KEY, (F.col("seq") - width).alias("seq"), F.col("rank").alias("next"))
        paired = (
            level.join(beyond, [*KEY, "seq"], "left")
            .withColumn("next", F.when(F.col("seq") + width >= F.col("n"), F.lit(-1)).otherwise(F.col("next")))
            .filter(F.col("next").isNotNull())
            .withColumnRenamed("rank", "own")
        )
        paired = written(paired)
        level = written(paired.join(named(paired, ["own", "next"]), ["own", "next"]).select(*KEY, "seq", "line_no", "n", "rank"))
        levels.append(level)
        width *= 2
    return levels


def intervals(levels: list[DataFrame], min_lines: int) -> DataFrame:
    """Suffixes by the interval of the suffix order whose common prefix is ``min_lines`` long: (id, tie, seq, a, b).

    Two overlapping stretches of a power of two lines make up any length.
    """
    k = min(min_lines.bit_length() - 1, len(levels) - 1)
    gap = min_lines - 2**k
    level = levels[k].filter(F.col("seq") + min_lines <= F.col("n"))
    if 2 ** (k + 1) <= min_lines:  # no run is that long
        return level.filter("false").select(*KEY, "seq", F.col("rank").alias("a"), F.col("rank").alias("b"))
    ahead = levels[k].select(*KEY, (F.col("seq") - gap).alias("seq"), F.col("rank").alias("b"))
    return level.withColumnRenamed("rank", "a").join(ahead, [*KEY, "seq"]).select(*KEY, "seq", "a", "b")


def removed_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(id, tie, runs, n_removed, longest) of documents with later copies; a run is (from, to) in line numbers, ``to`` excluded."""
    lines = written(sequences(docs))
    levels = doubled(lines)
    places = written(intervals(levels, min_lines))
    first = places.groupBy("a", "b").agg(F.min(F.struct(*KEY, "seq")).alias("first"))
    later = places.join(first, ["a", "b"]).filter(F.struct(*KEY, "seq") != F.col("first")).select(*KEY, "seq")
    # deep levels give the longest stretch that a later copy is known to share, as a power of two
    depth = None
    for k, level in enumerate(levels):
        shared = level.filter(F.col("seq") + 2**k <= F.col("n")).groupBy(*KEY).agg(F.lit(2**k).alias("longest"))
        depth = shared if depth is None else depth.unionByName(shared)
    covered = later.select(*KEY, F.explode(F.sequence(F.col("seq"), F.col("seq") + min_lines - 1)).alias("seq")).distinct()
    numbered = covered.join(lines.select(*KEY, "seq", "line_no"), [*KEY, "seq"])
    in_doc = Window.partitionBy(*KEY).orderBy("seq")
    islands = (
        numbered.withColumn("island", F.col("seq") - F.row_number().over(in_doc))
        .groupBy(*KEY, "island")
        .agg(F.min("line_no").alias("from"), (F.max("line_no") + 1).alias("to"), F.count("*").alias("n"))
    )
    runs = islands.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"), F.sum("n").alias("n_removed")
    )
    return runs.join(depth.groupBy(*KEY).agg(F.max("longest").alias("longest")), KEY)


def kept_text(text: Column, runs: Column) -> Column:
    """The lines outside the runs, joined again; blank lines inside a run go with it."""
    lines = F.split(text, "\n")
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["to"]))
    ends = F.concat(F.transform(runs, lambda r: r["from"]), F.array(F.size(lines)))
    pieces = F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, F.greatest(e - s, F.lit(0))))
    return F.when(runs.isNull(), text).otherwise(F.array_join(F.flatten(pieces), "\n"))


def dedup(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Rows of ``docs`` as (doc_id, text, n_lines, n_removed, n_runs, shared_lines, kept).

    Every run of at least ``min_lines`` lines that also stands earlier (smaller id, then text digest, then
    line) is deleted; all its lines are, where repeats overlap. Lines are compared byte by byte; blank lines
    count for nothing and go only inside a run. ``shared_lines`` is the largest power of two of lines that
    a document with deletions shares with another place. Null texts count as empty and stay null in ``kept``; rows
    with equal id and text are one document and get the same result; null ids rank first.
    """
    runs = removed_runs(docs, min_lines)
    filled = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs.select("text", doc_id().alias("id"), tie().alias("tie")).join(runs, KEY, "left").select(
        real_id().alias("doc_id"),
        "text",
        F.coalesce(F.size(filled), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("bigint").alias("n_runs"),
        F.coalesce("longest", F.lit(0)).cast("bigint").alias("shared_lines"),
        kept_text(F.col("text"), F.col("runs")).alias("kept"),
    )


SQL = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
filled AS (SELECT doc_id, line, no, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS seq FROM cut WHERE trim(line, ' ') <> ''),
pairs AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY seq) AS after FROM filled),
ranked AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, seq) AS copy FROM pairs WHERE after IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, seq + d AS seq FROM ranked, (VALUES (0), (1)) AS t(d) WHERE copy > 1),
marked AS (SELECT f.*, g.seq IS NOT NULL AS out_, f.seq - row_number() OVER (PARTITION BY f.doc_id, g.seq IS NOT NULL ORDER BY f.seq) AS island FROM filled f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.seq = g.seq),
runs AS (SELECT doc_id, min(no) AS a, max(no) AS b, count(*) AS n FROM marked WHERE out_ GROUP BY doc_id, island),
stats AS (SELECT doc_id, sum(n) AS n_removed, count(*) AS n_runs FROM runs GROUP BY doc_id),
kept AS (
  SELECT c.doc_id, string_agg(line, chr(10) ORDER BY no) AS kept FROM cut c
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = c.doc_id AND c.no BETWEEN r.a AND r.b) GROUP BY c.doc_id),
sizes AS (SELECT doc_id, count(*) AS n_lines FROM filled GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(z.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(s.n_runs, 0) AS BIGINT) AS n_runs, md5(coalesce(k.kept, '')) AS kept_md5
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN stats s ON s.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
