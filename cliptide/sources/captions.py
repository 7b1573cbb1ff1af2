"""Caption scans and caption-memory documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliptide.functions import text as X
from cliptide.functions import times
from cliptide.operators import carry, intervals
from cliptide.sources import subtitles
from cliptide.sources.lines import read_files, to_lines


def caption_blocks(
    files: DataFrame, keys: list[str], stride: int = 1, clip_length: int = 30, format_time: bool = True
) -> DataFrame:
    """Every ``stride``-th caption line with its time span; kept line i starts at i*stride*length."""
    lines = to_lines(files, keys).filter(F.col("pos") % stride == 0)
    start = F.col("pos").cast("bigint") * clip_length
    end = start + clip_length
    show = (lambda s: times.format_seconds(s.cast("double"))) if format_time else (lambda s: s.cast("string"))
    label = F.concat(show(start), F.lit(" --> "), show(end))
    return lines.select(
        *keys, (F.col("pos") / stride).cast("bigint").alias("index"), start.alias("start"), end.alias("end"), label.alias("time_label"), F.col("line").alias("text")
    )


def first_existing(wanted: DataFrame, files: DataFrame, row: str, candidates: list[Column]) -> DataFrame:
    """Text of the first candidate file name that exists, empty if none does."""
    listed = F.array(*[F.struct(F.lit(i).alias("prio"), c.alias("name")) for i, c in enumerate(candidates)])
    tries = wanted.select(row, F.explode(listed).alias("t")).select(row, "t.prio", "t.name")
    found = tries.join(files.select("name", "text"), "name").groupBy(row).agg(F.min_by("text", "prio").alias("text"))
    return wanted.join(found, row, "left").withColumn("text", F.coalesce("text", F.lit("")))


def keyed_json_captions(spark: SparkSession, path: str, sections: list[str], stride: int = 1, clip_length: int = 30) -> DataFrame:
    """Folders of numbered, fenced JSON caption files: chosen sections joined per clip.

    The folder is the video, the file number orders the clips, the first and last line are fences.
    """
    files = read_files(spark, path, ".json", recursive=True)
    parts = F.split("path", "/")
    lines = F.split(F.regexp_replace("text", "\n$", ""), "\n")
    body = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    pieces = [F.concat(F.lit(f"{s}.\n"), F.get_json_object(body, f"$['{s}']")) for s in sections]
    rows = files.select(
        F.element_at(parts, -2).alias("video_id"),
        F.get(F.split("name", "[.]"), 0).cast("bigint").alias("number"),
        F.concat_ws("\n", *pieces).alias("text"),
    )
    chunk = carry.chunk_if_hot(rows, ["video_id"], F.floor(F.col("number") / 4096))
    numbered = carry.position(rows, ["video_id"], ["number"], chunk, "n").withColumn("n", F.col("n") - 1)
    placed = numbered.filter(F.col("n") % stride == 0)
    start = F.col("n").cast("double") * clip_length
    return placed.select(
        "video_id", (F.col("n") / stride).cast("bigint").alias("index"), start.alias("start"), (start + clip_length).alias("end"), "text"
    )


def look_back_captions(
    queries: DataFrame, files: DataFrame, keys: list[str], row: str, at: str, stamp: str, window: int = 300_000
) -> DataFrame:
    """Caption files stamped within the look-back window, each ending where the next one starts.

    The last file of a query has no end and is dropped.
    """
    moment, hours = F.col(at).cast("bigint"), F.floor(F.col(at) / 1_000_000)
    into = moment % 1_000_000
    here = F.struct((moment - F.least(F.lit(window), into)).alias("lo"), moment.alias("hi"))
    before = F.struct(
        ((hours - 1) * 1_000_000 + 600_000 - (F.lit(window) - into)).alias("lo"),
        ((hours - 1) * 1_000_000 + 600_000).alias("hi"),
    )
    spans = queries.withColumn("__s", F.explode(F.when(into < window, F.array(before, here)).otherwise(F.array(here))))
    celled = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("__s.lo") / window), F.floor(F.col("__s.hi") / window))))
    placed = files.withColumn("cell", F.floor(F.col(stamp) / window))
    hits = celled.join(placed, [*keys, "cell"]).filter(F.col(stamp).between(F.col("__s.lo"), F.col("__s.hi")))
    # a window per query row holds the few files of its look-back span
    order = Window.partitionBy(row).orderBy(stamp)
    ended = hits.withColumn("next_stamp", F.lead(stamp).over(order)).filter(F.col("next_stamp").isNotNull())

    def clock(c: Column) -> Column:
        d = F.lpad(c.cast("string"), 8, "0")
        return F.concat(F.substring(d, 1, 2), F.lit(":"), F.substring(d, 3, 2), F.lit(":"), F.substring(d, 5, 2), F.lit("."), F.substring(d, 7, 2))

    return ended.withColumn("time_label", F.concat(clock(F.col(stamp)), F.lit(" --> "), clock(F.col("next_stamp")))).drop("cell", "__s")


def clean_caption(text: Column, keep_transcript: bool = False) -> Column:
    """One line per clip: no transcript tail, no leading label, single blanks."""
    shown = text if keep_transcript else F.substring_index(text, "ASR transcript:", 1)
    place = F.instr(shown, F.lit("Visual caption:"))
    without = F.concat(
        F.substring(shown, F.lit(1), place - 1), F.substring(shown, place + len("Visual caption:"), F.length(shown))
    )
    return X.squeeze(F.when(place > 0, without).otherwise(shown))


def memory_documents(
    captions: DataFrame, cues: DataFrame, keys: list[str], memory: str = "caption_subtitle", width: int = 30
) -> DataFrame:
    """Documents of a caption, subtitle or joint memory from timed blocks.

    Joint documents are captions with the subtitle blocks that overlap them in time; without
    captions the subtitles stand alone.
    """
    def alone(blocks: DataFrame, name: str, title: str) -> DataFrame:
        shown = subtitles.render_block(F.col("start"), F.col("end"), F.col("time_label"), F.col("text"))
        empty = F.lit("")
        return blocks.select(
            *keys,
            F.concat(F.lit(f"{name}:"), F.col("index").cast("string")).alias("doc_id"),
            F.col("index").alias("clip_idx"),
            "start",
            "end",
            times.time_range(F.col("start"), F.col("end")).alias("time"),
            (shown if name == "caption" else empty).alias("caption"),
            (shown if name == "subtitle" else empty).alias("subtitle"),
            F.concat(F.lit(f"{title}:\n"), "text").alias("text"),
        )

    if memory == "caption":
        return alone(captions, "caption", "Caption")
    if memory == "subtitle":
        return alone(cues, "subtitle", "Subtitle")
    if memory != "caption_subtitle":
        raise ValueError(f"unknown selector memory: {memory}")
    docs = alone(captions, "caption", "Caption")
    pairs = intervals.overlap_join(captions, cues, keys, ("start", "end"), width)
    shown = subtitles.render_block(F.col("r_start"), F.col("r_end"), F.col("r_time_label"), F.col("r_text"))
    matched = pairs.groupBy(*keys, F.col("l_index").alias("clip_idx")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("r_index").alias("i"), shown.alias("t")))).alias("m")
    )
    said = matched.select(*keys, "clip_idx", F.array_join(F.transform("m", lambda x: x["t"]), "\n\n").alias("said"))
    joint = docs.join(said, [*keys, "clip_idx"], "left").withColumns(
        {
            "subtitle": F.coalesce("said", F.lit("")),
            "text": F.when(F.col("said").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n\nSubtitle:\n"), "said")),
        }
    ).drop("said")
    without = alone(cues, "subtitle", "Subtitle").join(captions.select(*keys).distinct(), keys, "left_anti")
    return joint.select(*docs.columns).unionByName(without)
