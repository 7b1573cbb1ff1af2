"""Queries of this subpackage over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.llm import (
    decontaminate,
    discriminant,
    jaccard,
    licenses,
    linedup,
    longrepeats,
    mixing,
    phrases,
    pivots,
    ppm,
    spelling,
    toxicity,
    unitdedup,
)
from cliptide.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


@query("op8_source_mix", mixing.SQL)
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_toxicity")
def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op3_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))


@query("op6_line_dedup", linedup.SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return linedup.dedup(docs).select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.md5(F.coalesce("kept", F.lit("")).cast("binary")).alias("kept_md5")
    )


@query("op4_unit_dedup")
def unit_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return unitdedup.dedup(table(spark, folder, "documents").select("doc_id", "text"))


@query("op9_jaccard_join")
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query("op1_decontaminate")
def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, folder, "benchmark"))


@query("op5_pivot_index")
def pivot_index(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query("op2_ppm_score")
def ppm_score(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.score(table(spark, folder, "documents").select("doc_id", "text"))


@query("op7_long_repeats")
def long_repeats(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return longrepeats.remove(docs).drop("spans")


@query("op11_phrases", phrases.SQL)
def phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents").select("lang", "text"))


@query("op12_spelling_variants")
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group(table(spark, folder, "documents").select("doc_id", "text"))


@query("op13_quality")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return discriminant.quality(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
