"""Subtitle scans: SRT text, timed blocks, JSON cues and look-back windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.functions import times
from cliptide.operators import carry
from cliptide.operators.carry import Running
from cliptide.sources.lines import line_chunk, to_lines

# Fixed value: the header line of a timed block.
_CLOCK = r"(?:\d{1,2}:\d{2}:\d{2}(?:[,.]\d+)?|\d+(?:\.\d+)?)"
HEADER = rf"^\s*({_CLOCK})\s*-->\s*({_CLOCK})"


def _every(lines: DataFrame, keys: list[str], stride: int) -> DataFrame:
    """Every ``stride``-th remaining line of each file."""
    if stride == 1:
        return lines
    placed = carry.position(lines, keys, ["pos"], line_chunk(), "__n")
    return placed.filter((F.col("__n") - 1) % stride == 0).drop("__n")


def srt_lines(files: DataFrame, keys: list[str], stride: int = 1, include_time: bool = True) -> DataFrame:
    """Subtitle lines of SRT files.

    With times: markup is removed and every ``stride``-th blank-separated block kept. Without:
    counters and time lines go too. Either way the kept lines are strided once more.
    """
    lines = to_lines(files, keys).withColumn("line", F.trim("line"))
    bare = F.regexp_replace("line", "<.*?>", "")
    if include_time:
        lines = lines.withColumn("line", bare)
        blank = F.when(F.length("line") == 0, 1).otherwise(0)
        counted = carry.running(lines, keys, ["pos"], line_chunk(), {"__b": Running("sum", blank, inclusive=False)})
        kept = counted.filter(F.coalesce("__b", F.lit(0)) % stride == 0).drop("__b")
    else:
        spoken = lines.filter(~F.col("line").rlike("^[0-9]+$") & ~F.col("line").contains("-->")).withColumn("line", bare)
        placed = carry.position(spoken, keys, ["pos"], line_chunk(), "__n")
        kept = placed.filter(((F.col("__n") - 1) % stride == 0) & (F.length("line") > 0)).drop("__n")
    return _every(kept, keys, stride)


def timed_blocks(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Blocks opened by a time line; a text without any time line is one untimed block.

    A line's block is the running count of time lines, so no file is folded by hand.
    """
    lines = to_lines(files, keys, text).withColumn("line", F.trim("line"))
    header = F.col("line").rlike(HEADER)
    counted = carry.running(
        lines, keys, ["pos"], line_chunk(), {"block": Running("sum", F.when(header, 1).otherwise(0))}
    )
    body = ~header & (F.length("line") > 0) & ~F.col("line").rlike("^[0-9]+$")
    item = F.when(body, F.struct("pos", "line"))
    blocks = counted.groupBy(*keys, "block").agg(
        F.max(F.when(header, F.col("line"))).alias("head"),
        F.array_sort(F.collect_list(item)).alias("parts"),
    )
    start = times.parse_seconds(F.regexp_extract("head", HEADER, 1))
    end = times.parse_seconds(F.regexp_extract("head", HEADER, 2))
    shaped = blocks.filter(F.size("parts") > 0).select(
        *keys,
        "block",
        F.when(F.col("block") > 0, start).alias("start"),
        F.when(F.col("block") > 0, end).alias("end"),
        F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text"),
        "head",
    )
    # text before the first time line counts only if no timed block has any
    timed = shaped.filter("block > 0").select(*keys).distinct().withColumn("__timed", F.lit(True))
    kept = shaped.join(timed, keys, "left").filter(F.col("__timed").isNull() | (F.col("block") > 0)).drop("__timed")
    label = F.when(F.col("block") > 0, times.time_range(F.col("start"), F.col("end"), F.col("head"))).otherwise(F.lit(""))
    placed = carry.position(kept.withColumn("time_label", label), keys, ["block"], F.floor(F.col("block") / 4096), "index")
    return placed.select(*keys, (F.col("index") - 1).alias("index"), "start", "end", "time_label", "text")


def render_block(start: Column, end: Column, label: Column, text: Column) -> Column:
    shown = F.when(F.length(label) > 0, label).otherwise(times.time_range(start, end))
    return F.when(F.length(shown) > 0, F.concat(shown, F.lit("\n"), text)).otherwise(text)


def json_cue_text(elements: DataFrame, keys: list[str], order: str, include_time: bool = True) -> DataFrame:
    """Cue lines of the two JSON layouts (start/end/line and timestamp/text), one row per cue."""
    def field(name: str) -> Column:
        return F.col(name).cast("string") if name in elements.columns else F.lit(None).cast("string")

    stamp = F.col("timestamp") if "timestamp" in elements.columns else F.lit(None).cast("array<string>")
    start = F.coalesce(field("start"), F.get(stamp, 0).cast("string"))
    end = F.coalesce(field("end"), F.get(stamp, 1).cast("string"))
    text = F.coalesce(field("line"), field("text"))
    if not include_time:
        return elements.select(*keys, F.col(order).alias("pos"), field("line").alias("line"))
    cue = F.concat(start, F.lit(" --> "), end, F.lit("\n"), text, F.lit("\n"))
    return elements.filter(start.isNotNull()).select(*keys, F.col(order).alias("pos"), cue.alias("line"))


def whole_second_cues(files: DataFrame, keys: list[str]) -> DataFrame:
    """SRT cues with bounds in whole seconds (fractions dropped) and the line after the time line."""
    lines = to_lines(files, keys)
    following = lines.select(*keys, (F.col("pos") - 1).alias("pos"), F.col("line").alias("text"))
    heads = lines.filter(F.col("line").contains("-->")).join(following, [*keys, "pos"], "left")

    def seconds(part: int) -> Column:
        stamp = F.trim(F.get(F.split("line", "-->"), part))
        return F.floor(times.parse_seconds(stamp)).cast("bigint")

    return heads.select(*keys, "pos", seconds(0).alias("start"), seconds(1).alias("end"), F.coalesce("text", F.lit("")).alias("text"))


def every_fourth_line(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines 2, 6, 10, … of a file: the spoken lines of a plain four-line cue layout."""
    lines = to_lines(files, keys, text)
    return lines.filter(F.col("pos") % 4 == 2).withColumnRenamed("pos", "line_no")


def hourly_cues(files: DataFrame, keys: list[str], hour: str) -> DataFrame:
    """Cues of hourly files with times packed as HHMMSSff integers; the text is two lines below."""
    lines = to_lines(files, [*keys, hour])
    spoken = lines.select(*keys, hour, (F.col("pos") - 2).alias("pos"), F.col("line").alias("text"))
    heads = lines.filter(F.col("line").contains("-->")).join(spoken, [*keys, hour, "pos"], "left")

    def packed(part: int) -> Column:
        digits = F.regexp_replace(F.trim(F.get(F.split("line", "-->"), part)), "[:,]", "")
        return F.col(hour) * 1_000_000 + F.substring(digits, F.lit(1), F.length(digits) - 1).cast("bigint")

    return heads.select(*keys, hour, "pos", packed(0).alias("start"), packed(1).alias("end"), "text")


def look_back_cues(
    queries: DataFrame, cues: DataFrame, keys: list[str], hour: str, at: str, window: int = 300_000
) -> DataFrame:
    """Cues of the query's hour within ``window`` before it, spilling into the hour before.

    Times are packed decimals, so the spill-over window is what the current hour leaves of it.
    """
    moment, hours = F.col(at).cast("bigint"), F.floor(F.col(at) / 1_000_000)
    into = moment % 1_000_000
    here = F.struct(hours.alias(hour), moment.alias("until"), F.lit(window).cast("bigint").alias("reach"), F.lit(False).alias("spill"))
    before = F.struct(
        (hours - 1).alias(hour),
        ((hours - 1) * 1_000_000 + 600_000).alias("until"),
        (F.lit(window) - into).cast("bigint").alias("reach"),
        F.lit(True).alias("spill"),
    )
    probes = queries.withColumn(
        "__p", F.explode(F.when(into < window, F.array(here, before)).otherwise(F.array(here)))
    ).select("*", "__p.*").drop("__p")
    # the hour before is read only when the current hour has a file
    present = cues.select(*keys, (F.col(hour) - 1).alias(hour)).distinct().withColumn("__here", F.lit(True))
    checked = probes.join(present, [*keys, hour], "left").filter(~F.col("spill") | F.col("__here")).drop("__here")
    joined = checked.join(cues, [*keys, hour])
    return joined.filter((F.col("start") + F.col("reach") >= F.col("until")) & (F.col("end") <= F.col("until"))).drop(
        "until", "reach", "spill"
    )
