"""Text files as ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines per chunk when a running count over a long file is carried along.
LINE_CHUNK = 4096


def read_files(spark: SparkSession, path: str, suffix: str = "", recursive: bool = False) -> DataFrame:
    """One row per file: ``path``, ``name`` (without suffix) and whole ``text``."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    rows = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    name = F.element_at(F.split(F.url_decode("path"), "/"), -1)
    stem = F.substring(name, F.lit(1), F.length(name) - len(suffix)) if suffix else name
    return rows.withColumn("name", stem)


def to_lines(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines in file order, counted from zero; a final line break opens no further line."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n$", "")
    return files.filter(F.length(text) > 0).select(*keys, F.posexplode(F.split(body, "\n")).alias("pos", "line"))


def line_chunk() -> Column:
    return F.floor(F.col("pos") / LINE_CHUNK)


def as_text(lines: DataFrame, keys: list[str], separator: str = "\n", order: str = "pos", line: str = "line") -> DataFrame:
    """Put the lines of each file back together (a file's text is one value by definition)."""
    packed = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))).alias("__l"))
    return packed.select(*keys, F.array_join(F.transform("__l", lambda x: x["l"]), separator).alias("text"))
