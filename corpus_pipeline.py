"""The training-data pipeline: toxicity, line dedup, near duplicates, benchmark passages, mixing.

Each stage takes the documents that the stage before kept and returns those it keeps, with the columns of
``documents``; the last returns the mix, a row per copy. ``run`` writes every stage into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.llm import decontaminate, jaccard, linedup, mixing, toxicity
from cliptide.llm.common import doc_id, table, tie, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not hold for toxic; it learns from the labels of ``docs``."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines, ``n_chars`` with them; a text that loses all its lines goes.

    Texts without deletions, empty ones among them, stay as they are.
    """
    runs = linedup.removed_runs(docs)
    keys = docs.withColumns({"__id": doc_id(), "__tie": tie()})
    joined = keys.join(runs.select(F.col("id").alias("__id"), F.col("tie").alias("__tie"), F.col("runs").alias("__runs")), ["__id", "__tie"], "left")
    cut = joined.withColumn("__kept", linedup.kept_text(F.col("text"), F.col("__runs")))
    changed = {"text": F.col("__kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__runs").isNull(), F.col("n_chars")).otherwise(F.length("__kept")).cast(docs.schema["n_chars"].dataType)
    stays = F.col("__runs").isNull() | (F.trim("__kept") != "")
    return cut.filter(stays).withColumns(changed).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at 0.8 or more join: the one with the smallest id."""
    return jaccard.keep_first(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no item of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as systematic sampling takes it, numbered in ``copy``.

    If ``docs`` has a column of that name, in whatever case, underscores are added to the number's. Null texts and
    texts without words have size 0, a null source is a source, repeated rows are documents of their own, ties in
    size stand by id, and an empty table gives none.
    """
    taken, number = {c.lower() for c in docs.columns}, "copy"
    while number in taken:
        number += "_"
    mixed = mixing.mix(docs, keep=docs.columns)
    return mixed.filter("copies > 0").select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(number))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing sources", mix_sources),
]

#: No SQL for the classifier; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
