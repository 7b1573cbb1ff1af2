"""JSON-lines records of questions with candidates, nodes or documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = "relevance double, vector array<float>, embedding array<float>, text string, start double, end double, metadata map<string,string>"
CANDIDATES = f"array<struct<clip_id string, {_ITEM}>>"
NODES = f"array<struct<node_id string, clip_id string, memory_type string, type string, {_ITEM}>>"
DOCUMENTS = "array<struct<clip_id string, text string, start double, end double>>"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON object: key, whole object as ``record``. Blank lines are skipped.

    A line that is no object is an error naming its file. The key is a digest of the line, so a
    lost task recomputes the same keys.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = rows.filter(F.length(F.trim("value")) > 0)
    parsed = F.try_parse_json("value")
    broken = F.concat(F.lit("not a JSON object in "), F.col("file"), F.lit(": "), F.col("value"))
    good = F.schema_of_variant(parsed).startswith("OBJECT")
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("value")).otherwise(F.raise_error(broken).cast("string"))
    return lines.select(F.sha2("value", 256).alias("record_id"), checked.alias("record"))


def field(name: str, kind: str = "string") -> Column:
    """Top-level field of a record as a typed value."""
    text = F.get_json_object("record", f"$.{name}")
    return text.cast(kind) if kind in {"string", "int", "double", "boolean", "bigint"} else F.from_json(text, kind)


def first_of(*names: str) -> Column:
    return F.coalesce(*[field(n) for n in names])


def passthrough(*dropped: str) -> Column:
    """The record as a map of variants without the dropped keys."""
    whole = F.from_json("record", "map<string,variant>")
    return F.map_filter(whole, lambda k, v: ~k.isin(*dropped))


def _vector(item: str) -> Column:
    given = F.coalesce(F.col(f"{item}.vector"), F.col(f"{item}.embedding"))
    return F.coalesce(given, F.raise_error(F.lit("each candidate or node needs a vector or an embedding")).cast("array<float>"))


def candidates(records: DataFrame) -> DataFrame:
    """Candidate rows of the records that list candidates."""
    rows = records.select("record_id", F.posexplode(field("candidates", CANDIDATES)).alias("seq", "c"))
    return rows.select(
        "record_id",
        "seq",
        "c.clip_id",
        "c.relevance",
        _vector("c").alias("vector"),
        F.coalesce("c.text", F.lit("")).alias("text"),
        "c.start",
        "c.end",
        "c.metadata",
    )


def nodes(records: DataFrame, enabled: bool) -> DataFrame:
    """Node rows of the records without candidates; an error if nodes are not enabled."""
    given = F.get_json_object("record", "$.nodes")
    listed = records.filter(F.get_json_object("record", "$.candidates").isNull())
    message = F.when(given.isNull(), F.lit("each record needs candidates or nodes")).otherwise(
        F.lit("the record has nodes, but structured memory is off")
    )
    usable = given.isNotNull() & F.lit(enabled)
    text = F.when(usable, given).otherwise(F.raise_error(message).cast("string"))
    rows = listed.select("record_id", F.posexplode(F.from_json(text, NODES)).alias("seq", "n"))
    return rows.select(
        "record_id",
        "seq",
        "n.node_id",
        "n.clip_id",
        "n.relevance",
        _vector("n").alias("vector"),
        F.coalesce("n.memory_type", "n.type", F.lit("")).alias("memory_type"),
        F.coalesce("n.text", F.lit("")).alias("text"),
        "n.start",
        "n.end",
    )


def video_id() -> Column:
    missing = F.raise_error(F.lit("a row needs video_id, video or vid")).cast("string")
    return F.coalesce(first_of("video_id", "video", "vid"), missing)


def caption_memory(memory: DataFrame) -> DataFrame:
    """Clip rows of a caption memory: one clip per record or a list of clips, in list order."""
    clip = (
        "struct<clip_id string, caption string, description string, asr string, transcript string, "
        "start double, end double>"
    )
    listed = F.coalesce(field("clips", f"array<{clip}>"), F.array(F.from_json("record", clip)))
    rows = memory.select(video_id().alias("video_id"), "record_id", F.posexplode(listed).alias("seq", "c"))
    seen = F.trim(F.coalesce(F.nullif(F.col("c.caption"), F.lit("")), F.col("c.description"), F.lit("")))
    said = F.trim(F.coalesce(F.nullif(F.col("c.asr"), F.lit("")), F.col("c.transcript"), F.lit("")))
    parts = F.array_compact(
        F.array(
            F.when(seen != "", F.concat(F.lit("Visual description: "), seen)),
            F.when(said != "", F.concat(F.lit("Transcript: "), said)),
        )
    )
    return rows.select("video_id", "seq", "c.clip_id", "c.start", "c.end", F.array_join(parts, "\n").alias("text"))


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON-lines sink; the output committer publishes the files only when the job succeeds."""
    df.write.mode(mode).json(path)
