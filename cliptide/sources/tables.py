"""Small table formats: CSV with ids, pair lists, run logs, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.operators import intervals
from cliptide.sources.lines import read_files


def unique_or_fail(df: DataFrame, key: str) -> DataFrame:
    """The table itself; a duplicate or missing key is an error when it is read.

    Keys are counted map-side and joined back, so no key gathers its rows in one task.
    """
    if key not in df.columns:
        raise KeyError(f"column {key} is required")
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    message = F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))
    absent = F.raise_error(F.lit(f"missing {key}")).cast(df.schema[key].dataType)
    return (
        df.withColumn(key, F.coalesce(F.col(key), absent))
        .join(counts, key)
        .withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(message).cast("bigint")).otherwise(F.col("__n")))
        .filter("__n = 1")
        .drop("__n")
    )


def read_csv(spark: SparkSession, path: str, key: str = "ID") -> DataFrame:
    """CSV with a header and a mandatory unique id column; all values are text."""
    return unique_or_fail(spark.read.option("header", "true").csv(path), key)


def read_pairs(spark: SparkSession, path: str, unique: bool = True) -> DataFrame:
    """Whitespace-separated ``key value`` lines."""
    parts = F.split(F.trim("value"), "[ \t]+", 2)
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(
        F.get(parts, 0).alias("key"), F.get(parts, 1).alias("val")
    )
    rows = rows.withColumnRenamed("val", "value")
    return unique_or_fail(rows, "key") if unique else rows


def read_transcript_times(spark: SparkSession, path: str) -> DataFrame:
    """``speaker start end text`` lines."""
    parts = F.split(F.trim("value"), "[ \t]+", 4)
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(
        F.get(parts, 0).alias("speaker"),
        F.get(parts, 1).cast("double").alias("start"),
        F.get(parts, 2).cast("double").alias("end"),
        F.get(parts, 3).alias("text"),
    )


def read_run(spark: SparkSession, folder: str) -> DataFrame:
    """Result logs ``<integer>.json`` of a run folder; other names are skipped."""
    files = read_files(spark, folder, ".json").filter(F.col("name").rlike("^[0-9]+$"))
    text = F.col("text")
    return files.select(
        F.col("name").cast("bigint").alias("global_idx"),
        F.get_json_object(text, "$.response").alias("response"),
        F.get_json_object(text, "$.answer").alias("answer"),
        F.coalesce(
            F.get_json_object(text, "$.retrieval_trace.selector"), F.get_json_object(text, "$.evidence_selector")
        ).alias("selector"),
        F.coalesce(
            F.get_json_object(text, "$.retrieval_trace.memory"), F.get_json_object(text, "$.selector_memory")
        ).alias("memory"),
        selected_count(text).alias("k"),
    )


def selected_count(record: Column) -> Column:
    """Depth of a run log: the trace's count, else the selector trace's; not an integer is null."""
    outer = F.get_json_object(record, "$.retrieval_trace.selected_count")
    inner = F.get_json_object(record, "$.retrieval_trace.selector_trace.selected_count")
    return F.when(outer.isNotNull(), outer.try_cast("int")).otherwise(inner.try_cast("int"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, partition: str | None = None) -> None:
    """Store a memory graph as two Parquet tables (partitioned by graph, so one graph is pruned)."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        writer = df.write.mode("overwrite")
        if partition:
            writer = writer.partitionBy(partition)
        writer.parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def rttm_lines(segments: DataFrame, recording: str) -> DataFrame:
    """Diarisation segments as RTTM lines."""
    line = F.format_string(
        "SPEAKER %s 0 %.3f %.3f <NA> <NA> %s <NA> <NA>",
        F.col(recording),
        F.col("start"),
        F.col("end") - F.col("start"),
        F.col("speaker").cast("string"),
    )
    return segments.select(recording, "start", line.alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("errorifexists").text(path)


def prediction_export(items: DataFrame, dataset: str) -> DataFrame:
    """Question export for an outside route classifier."""
    return items.select(
        F.col("global_idx").cast("string").alias("id"),
        "question",
        F.lit("").alias("answer"),
        F.lit(dataset).alias("dataset"),
        F.col("video_id").alias("video"),
    )


def fill_predictions(reference: DataFrame, predictions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Predicted labels joined into the reference rows, and counts of answered, missed and valid."""
    filled = reference.join(predictions, keys, "left")
    label = F.col("predicted_answer_label")
    counts = filled.agg(
        F.count("*").alias("total"),
        F.count(label).alias("answered"),
        F.count_if(label.isNull()).alias("missed"),
        F.count_if(label.isin("A", "B", "C", "D", "E")).alias("valid"),
    )
    return filled, counts


def usage_rows(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Model calls with their cost in USD (prices per million tokens)."""
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6
    return calls.join(prices, "model", "left").withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop(
        "input_price", "output_price"
    )


def append_usage(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def clip_listing(files: DataFrame, name: str, seconds: str, frames: str) -> DataFrame:
    """Clips long enough to remember, with a numbers-first sort key."""
    kept = files.filter((F.col(seconds) >= 2) & (F.col(frames) >= 24))
    number = F.col(name).try_cast("int")
    return kept.withColumn("sort_key", F.struct(number.isNull().alias("text"), number.alias("number"), F.col(name).alias("name")))


def merged_vad(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Union of two speech interval lists with touching intervals merged."""
    both = left.select(*keys, "start", "end").unionByName(right.select(*keys, "start", "end")).distinct()
    return intervals.merge_intervals(both, keys, "end", F.floor(F.col("start") / width))
