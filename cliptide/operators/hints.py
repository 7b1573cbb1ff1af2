"""Who a name in a question may refer to: names of characters found by letters they share, then scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.functions import names as N
from cliptide.operators.identity import person_name

#: Letters of the pieces that find a name inside another.
GRAM = N.INSIDE_LETTERS


def _grams(name: Column) -> Column:
    places = F.when(F.length(name) >= GRAM, F.sequence(F.lit(1), F.length(name) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda at: F.substring(name, at, GRAM)))


def _keys(name: Column, contained: str, containing: str) -> Column:
    """Keys that two names share if one can resemble the other: the start, or the first piece of the name inside."""
    first = F.slice(_grams(name), 1, 1)
    return F.concat(
        F.array(F.concat(F.lit("start:"), F.substring(name, 1, N.SHARED_START))),
        F.transform(first, lambda g: F.concat(F.lit(contained), g)),
        F.transform(_grams(name), lambda g: F.concat(F.lit(containing), g)),
    )


def character_names(told: DataFrame, members: DataFrame, graph: list[str]) -> DataFrame:
    """(graph, character, name, spelled): every name that was told for a voice of a character, as compared and as first spelled."""
    rows = told.join(members.withColumnRenamed("node_id", "voice"), [*graph, "voice"])
    named = rows.select(*graph, "character", person_name(F.col("name")).alias("name"), F.trim("name").alias("spelled")).filter("name <> ''")
    return named.groupBy(*graph, "character", "name").agg(F.min("spelled").alias("spelled"))


def identity_hints(queries: DataFrame, named: DataFrame, graph: list[str], key: list[str], name: str) -> DataFrame:
    """(graph, key, character, candidate, score, rank): characters whose names resemble the asked one, best first.

    ``named`` comes from ``character_names``. Names are compared once per graph and spelling, only where they start with the same two letters or
    where the first three letters of one stand in the other, which every pair with a score above zero does.
    Ties go to the smaller character, then the name.
    """
    asked = queries.select(*graph, *key, person_name(F.col(name)).alias("asked")).filter("asked <> ''")
    known = named.select(*graph, "name").distinct()
    left = asked.select(*graph, "asked").distinct()
    left = left.select(*graph, "asked", F.explode(_keys(F.col("asked"), "in:", "over:")).alias("__key"))
    right = known.select(*graph, "name", F.explode(_keys(F.col("name"), "over:", "in:")).alias("__key"))
    pairs = left.join(right, [*graph, "__key"]).select(*graph, "asked", "name").distinct()
    scored = pairs.withColumn("score", N.name_similarity(F.col("asked"), F.col("name"))).filter("score > 0")
    found = asked.join(scored, [*graph, "asked"]).join(named.select(*graph, "character", "name"), [*graph, "name"])
    order = F.struct((-F.col("score")).alias("less"), "character", "name")
    listed = found.groupBy(*graph, *key).agg(F.array_sort(F.collect_set(order)).alias("__all"))
    return listed.select(*graph, *key, F.posexplode("__all").alias("__at", "__one")).select(
        *graph, *key, "__one.character", F.col("__one.name").alias("candidate"), (-F.col("__one.less")).alias("score"), (F.col("__at") + 1).alias("rank")
    )


def names_of_character(queries: DataFrame, named: DataFrame, graph: list[str], key: list[str]) -> DataFrame:
    """Spellings told for the character that a question (graph, key, character) names."""
    return queries.join(named, [*graph, "character"]).select(*graph, *key, "character", "spelled")
