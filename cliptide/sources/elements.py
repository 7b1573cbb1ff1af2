"""Elements of large JSON arrays and maps, read by as many tasks as the file has splits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.operators import carry
from cliptide.operators.carry import Running
from cliptide.session import cut_lineage

#: An escape, and, once escapes are gone, a closed string and one that a piece leaves open.
ESCAPE, STRING, OPEN_STRING = r"(?s)\\.", '"[^"]*"', '"[^"]*$'


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): text up to each closing brace, in the order of (block, at) within a file.

    The reader splits a file anywhere and gives each piece to one task, as it does with lines.
    """
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def json_elements(spark: SparkSession, path: str, keyed: bool = False) -> DataFrame:
    """(file, n, element): the objects of a JSON array, or with ``keyed`` the members of a map of objects, from zero.

    ``element`` is the JSON of the object, or a map of one member. Running counts of quotes tell whether a piece starts
    inside a string, then running counts of braces where an element ends; only sums per split are carried on.
    An object that never ends is left out.
    """
    clean = F.regexp_replace("value", ESCAPE, "")  # no escape reaches over a brace
    quotes = F.length("__clean") - F.length(F.replace(F.col("__clean"), F.lit('"'), F.lit("")))
    pieces = cut_lineage(_pieces(spark, path).withColumn("__clean", clean).withColumn("__q", quotes))
    order, chunk = ["block", "at"], F.col("block")
    quoted = carry.running(pieces, ["file"], order, chunk, {"__before": Running("sum", F.col("__q"), inclusive=False)})
    inside = F.coalesce("__before", F.lit(0)) % 2 == 1
    whole = F.when(inside, F.concat(F.lit('"'), "__clean")).otherwise(F.col("__clean"))
    bare = F.regexp_replace(F.regexp_replace(whole, STRING, ""), OPEN_STRING, "")
    closes = (F.coalesce("__before", F.lit(0)) + F.col("__q")) % 2 == 0  # else the brace is a letter of a string
    opened = F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))
    counted = cut_lineage(quoted.withColumn("__change", opened - closes.cast("int")))
    depth = cut_lineage(carry.running(counted, ["file"], order, chunk, {"__depth": Running("sum", F.col("__change"))}))
    ends = ((F.col("__depth") == (1 if keyed else 0)) & closes).cast("int")
    marked = cut_lineage(depth.withColumn("__end", ends))
    placed = carry.running(marked, ["file"], order, chunk, {"__n": Running("sum", F.col("__end"), inclusive=False)})
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    grouped = placed.groupBy("file", F.coalesce("__n", F.lit(0)).cast("bigint").alias("n")).agg(parts.alias("parts"), F.max("__end").alias("whole"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    bare_text = F.regexp_replace(text, r"^[\s,\[]+", "")
    member = F.concat(F.lit("{"), F.regexp_replace(text, r"^[\s,]*\{?[\s,]*(?=\")", ""), F.lit("}"))
    return grouped.filter("whole = 1").select("file", "n", (member if keyed else bare_text).alias("element"))


def element_schema(elements: DataFrame) -> str:
    """The schema that fits all elements, found by the tasks and merged."""
    found = elements.agg(F.schema_of_variant_agg(F.parse_json("element")).alias("s")).first().s
    return re.sub(r"DECIMAL\([0-9]+,\s*[0-9]+\)", "DOUBLE", found.replace("OBJECT<", "STRUCT<"))


def json_table(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects as a table, with the element number as ``n``."""
    elements = cut_lineage(json_elements(spark, path))
    if elements.isEmpty():
        return elements.select("n")
    return elements.select("n", F.from_json("element", element_schema(elements)).alias("e")).select("n", "e.*")
