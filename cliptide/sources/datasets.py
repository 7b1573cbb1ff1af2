"""Benchmark annotations as one item shape, declared as column mappings.

Every set is a projection of its annotation table; subtitles and captions are joined by video id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.functions import times
from cliptide.operators import carry
from cliptide.sources import elements


@dataclass(frozen=True)
class Mapping:
    """SQL expressions over the annotation columns; ``extra`` names the set's own fields."""

    video_id: str
    answer: str
    options: str = "cast(array() as array<string>)"
    question: str = "question"
    subtitle_id: str = ""
    caption_id: str = ""
    extra: dict[str, str] = field(default_factory=dict)
    format: str = "parquet"


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


#: One declaration per supported set.
DATASETS: dict[str, Mapping] = {
    "videomme": Mapping(
        "videoID", "answer", "options", extra=_same("duration", "sub_category", "domain", "task_type")
    ),
    "videommmu": Mapping("id", "answer", "options", extra=_same("question_type")),
    "longvideobench": Mapping(
        "video_id",
        "cast(correct_choice as int)",
        "array(option1, option2, option3, option4)",
        extra={"duration": "cast(duration as double)", "duration_group": "cast(duration_group as int)"},
    ),
    "cinepile": Mapping(
        "videoID",
        "cast(answer_key_position as int)",
        "choices",
        extra={**_same("question_category", "hard_split", "answer_key"), "subtitle": "replace(trim(subtitles), '<subtitle> ', '')"},
    ),
    "mlvu": Mapping(
        "split(video_name, '[.]')[0]",
        "answer",
        "candidates",
        extra={"duration": "cast(duration as double)", "task_type": "task_type"},
        format="parquet",
    ),
    "mmvu": Mapping(
        "id",
        "answer",
        "if(length(choices.A) = 0, cast(array() as array<string>), array(choices.A, choices.B, choices.C, choices.D, choices.E))",
        subtitle_id="if(youtube_url like '%=%', split(split(youtube_url, '=')[1], '&')[0], element_at(split(youtube_url, '/'), -1))",
        caption_id="split(element_at(split(video, 'videos/'), -1), '[.]')[0]",
        extra={"id": "id", "choices": "choices", "question_type": "question_type", "metadata": "metadata"},
        format="json",
    ),
    "mmworld": Mapping(
        "video_id",
        "correct_answer_label",
        "array(options.a, options.b, options.c, options.d)",
        subtitle_id="split(element_at(split(video_id, '/'), -1), '[.]')[0]",
        caption_id="concat(split(video_id, '[.]')[0], '/', split(element_at(split(video_id, '/'), -1), '[.]')[0])",
        extra={"requires_audio": "cast(requires_audio as boolean)", "discipline": "discipline"},
    ),
    "hourvideo": Mapping(
        "video_uid",
        "-1",
        "array(answer_1, answer_2, answer_3, answer_4, answer_5)",
        extra={"duration_in_seconds": "cast(duration_in_seconds as double)", **_same("task", "scenarios")},
    ),
    "videommlu": Mapping("video_id", "answer", extra=_same("type"), format="json"),
    "cgbench": Mapping(
        "video_uid",
        "answer",
        "choices",
        extra={
            "qid": "cast(qid as int)",
            "duration": "cast(duration as int)",
            **_same("sub_category", "domain", "right_answer"),
            "clue_intervals": "cast(clue_intervals as array<array<double>>)",
        },
        format="json",
    ),
    "egolife": Mapping(
        "''",
        "answer",
        "array(choice_a, choice_b, choice_c, choice_d)",
        extra={"qid": "cast(ID as int)", **_same("type", "query_time")},
        format="json",
    ),
    "minerva": Mapping(
        "video_id",
        "char(ascii('A') + answer_id)",
        "array(answer_choice_0, answer_choice_1, answer_choice_2, answer_choice_3, answer_choice_4)",
        extra=_same("question_type", "category"),
        format="json",
    ),
    "m3bench": Mapping(
        "video_id",
        "answer",
        "options",
        extra=_same("question_id", "question_type", "task_type", "reasoning", "subtitle", "caption"),
        format="json",
    ),
}


def read_annotations(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Annotation table of a set, with the columns its mapping expects."""
    kind = DATASETS[dataset_key(name)].format
    if kind == "parquet":
        return spark.read.parquet(path)
    return elements.json_table(spark, path).drop("n")


def dataset_key(name: str) -> str:
    lowered = name.lower()
    if "videommmu" in lowered:
        return "videommmu"
    if lowered in {"m3bench_web", "m3bench_robot"}:
        return "m3bench"
    if lowered not in DATASETS:
        raise NotImplementedError(f"unknown dataset: {name}")
    return lowered


def items(
    annotations: DataFrame, name: str, order: str, subtitles: DataFrame | None = None, captions: DataFrame | None = None
) -> DataFrame:
    """Items in the shared shape, numbered from zero by ``order``.

    ``subtitles`` and ``captions`` hold (video_id, text); a video without one gets an empty text.
    """
    m = DATASETS[dataset_key(name)]
    placed = carry.position(annotations, [], [order], F.floor(F.col(order) / 65536), "__n")
    rows = placed.select(
        (F.col("__n") - 1).alias("global_idx"),
        F.expr(m.video_id).cast("string").alias("video_id"),
        F.expr(m.question).alias("question"),
        F.expr(m.options).alias("options"),
        F.expr(m.answer).alias("answer"),
        *[F.expr(sql).alias(n) for n, sql in m.extra.items()],
        F.expr(m.subtitle_id or m.video_id).cast("string").alias("__subtitle"),
        F.expr(m.caption_id or m.video_id).cast("string").alias("__caption"),
    )
    for kind, texts in (("subtitle", subtitles), ("caption", captions)):
        if kind in m.extra:
            continue
        if texts is None:
            rows = rows.withColumn(kind, F.lit(""))
        else:
            named = texts.select(F.col("video_id").alias(f"__{kind}"), F.col("text").alias(kind))
            rows = rows.join(named, f"__{kind}", "left").withColumn(kind, F.coalesce(kind, F.lit("")))
    return rows.drop("__subtitle", "__caption")


def nested_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question rows of a JSON map video -> {qa_list, caption, subtitle}, in file order."""
    qa = (
        "struct<question_id string, question string, answer string, type array<string>, reasoning string, "
        "timestamp string, before_clip int>"
    )
    shape = f"map<string,struct<qa_list array<{qa}>, caption string, subtitle string>>"
    members = elements.json_elements(spark, path, keyed=True)
    videos = members.select(F.col("n").alias("v_pos"), F.explode(F.from_json("element", shape)).alias("key", "value"))
    rows = videos.select("v_pos", "key", "value", F.posexplode("value.qa_list").alias("q_pos", "qa"))
    keyed = rows.withColumn("ordinal", F.col("v_pos").cast("bigint") * 1_000_000 + F.col("q_pos"))
    return keyed.select(
        "ordinal",
        F.col("key").alias("video_id"),
        "qa.question",
        "qa.answer",
        F.array().cast("array<string>").alias("options"),
        F.col("qa.question_id").alias("question_id"),
        F.lit("open-ended").alias("question_type"),
        F.coalesce("qa.type", F.array().cast("array<string>")).alias("task_type"),
        F.coalesce("qa.reasoning", F.lit("")).alias("reasoning"),
        "qa.timestamp",
        "qa.before_clip",
        F.coalesce("value.subtitle", F.lit("")).alias("subtitle"),
        F.coalesce("value.caption", F.lit("")).alias("caption"),
    )


def reasoning_questions(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Flatten ``reasoning_qa`` lists and look the video's label up."""
    flat = rows.select("video_id", F.posexplode("reasoning_qa").alias("q_pos", "qa"))
    labels = categories.select("video_id", F.col("label").alias("type"))
    return flat.join(labels, "video_id").select("video_id", "q_pos", "qa.question", "qa.answer", "type")


def transcript_text(rows: DataFrame, keys: list[str], transcript: str) -> DataFrame:
    """Timed transcript text from {start, duration, text} elements."""
    def cue(e: Column) -> Column:
        return F.concat(
            times.format_seconds(e["start"]), F.lit(" --> "), times.format_seconds(e["start"] + e["duration"]), F.lit("\n"), e["text"], F.lit("\n")
        )

    return rows.select(*keys, F.array_join(F.transform(transcript, cue), "\n").alias("text"))


def known_ids(rows: DataFrame, listed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is listed, and the listed ids that do not occur (``#`` lines are comments)."""
    ids = (
        listed.select(F.trim("value").alias(key))
        .filter((F.length(key) > 0) & ~F.col(key).startswith("#"))
        .distinct()
    )
    return rows.join(ids, key, "left_semi"), ids.join(rows.select(key).distinct(), key, "left_anti")
