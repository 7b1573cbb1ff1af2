"""Joins between questions, memories, label maps and runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.functions import text as X
from cliptide.functions import times
from cliptide.operators import carry


def attach_memory(
    questions: DataFrame,
    memory: DataFrame,
    key: str,
    order: str,
    chunk: Column,
    keep_missing: bool = True,
) -> DataFrame:
    """One row per question and memory clip; ids and times default from the clip's ordinal.

    ``memory`` may hold clip_id, start and end; a question without memory keeps one row without
    a clip, or none if ``keep_missing`` is off.
    """
    chunk = carry.chunk_if_hot(memory, [key], chunk)
    placed = carry.position(memory, [key], [order], chunk, "ordinal").withColumn("ordinal", F.col("ordinal") - 1)
    length = times.CLIP_SECONDS
    begin = F.col("ordinal").cast("double") * length

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in memory.columns else F.lit(None).cast(kind)

    filled = placed.withColumns(
        {
            "clip_id": F.coalesce(given("clip_id", "string"), F.col("ordinal").cast("string")),
            "start": F.coalesce(given("start", "double"), begin),
            "end": F.coalesce(given("end", "double"), begin + length),
        }
    )
    return questions.join(filled, key, "left" if keep_missing else "inner")


def label_map(records: DataFrame, ids: list[str], question: str, label: Column, order: str) -> DataFrame:
    """Lookup keys ``id:…`` and ``question:…`` of label records; later records win."""
    keys = F.array(
        *[F.when(F.col(c).isNotNull(), F.concat(F.lit("id:"), F.col(c).cast("string"))) for c in ids],
        F.when(F.length(F.coalesce(F.col(question), F.lit(""))) > 0, F.concat(F.lit("question:"), X.text_key(F.col(question)))),
    )
    flat = records.select(F.explode(F.array_compact(keys)).alias("key"), label.alias("label"), F.col(order).alias("o"))
    return flat.filter(F.col("label") != "").groupBy("key").agg(F.max_by("label", "o").alias("label"))


def priority_lookup(items: DataFrame, row: str, keys: list[Column], labels: DataFrame, fallback: str) -> DataFrame:
    """Label of the first key that is known, else ``fallback``.

    Keys are joined with the label map on equality and reduced map-side by priority.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("prio"), k.alias("key")) for i, k in enumerate(keys)])
    exploded = items.select(row, F.explode(F.filter(listed, lambda k: k["key"].isNotNull())).alias("k")).select(
        row, "k.prio", "k.key"
    )
    found = exploded.join(labels, "key").groupBy(row).agg(F.min_by("label", "prio").alias("label"))
    return items.join(found, row, "left").withColumn("label", F.coalesce("label", F.lit(fallback)))


def trial_scores(trials: DataFrame, embeddings: DataFrame, key: str, vector: str, score: Callable) -> DataFrame:
    """Score each (enrol, test) trial; an embedding that is missing is an error."""
    out = trials
    for side in ("enrol", "test"):
        side_rows = embeddings.select(F.col(key).alias(side), F.col(vector).alias(f"{side}_vector"))
        out = out.join(side_rows, side, "left")
        out = out.withColumn(
            f"{side}_vector",
            F.coalesce(
                F.col(f"{side}_vector"),
                F.raise_error(F.concat(F.lit("no embedding for "), F.col(side).cast("string"))).cast("array<float>"),
            ),
        )
    return out.withColumn("score", score(F.col("enrol_vector"), F.col("test_vector"))).drop(
        "enrol_vector", "test_vector"
    )


def restrict_when_any(rows: DataFrame, allowed: DataFrame, query: list[str], node: str) -> DataFrame:
    """Keep the allowed nodes of each query; a query without allowed nodes is not restricted."""
    queries = allowed.select(*query).distinct().withColumn("__some", F.lit(True))
    pairs = allowed.select(*query, node).distinct().withColumn("__ok", F.lit(True))
    marked = rows.join(queries, query, "left").join(pairs, [*query, node], "left")
    return marked.filter(F.col("__some").isNull() | F.col("__ok")).drop("__some", "__ok")


def backfill(target: DataFrame, backup: DataFrame, key: str) -> DataFrame:
    """Target rows plus the backup rows whose key the target lacks."""
    return target.unionByName(backup.join(target.select(key), key, "left_anti"))


def remaining_items(items: DataFrame, done: DataFrame, key: str, limit: int = -1) -> DataFrame:
    """Items not processed yet; the first ``limit`` by key unless negative."""
    left = items.join(done.select(key).distinct(), key, "left_anti")
    return left if limit < 0 else left.orderBy(key).limit(limit)
