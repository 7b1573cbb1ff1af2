"""Prompt texts per question type, and search results as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Item columns with the sentence that introduces them, in prompt order.
_SUBTITLES = ("subtitle", "Subtitles of the video:\n")
_CAPTIONS = ("caption", "Captions of the video:\n")
_AUDIO = ("audio_captions", "Audio captions of the video:\n")
_FIGURE = ("question_caption", "Caption of the question's figure:\n")
_CHOOSE = "Answer with the letter of the best option."
_OPEN = "Answer the question in a few words."
_INTERVALS = "Answer with the list of [start, end] intervals, in seconds, that show the answer."

#: Question type -> (introduced columns, whether options are listed, closing request).
LAYOUTS: dict[str, tuple[list[tuple[str, str]], bool, str]] = {
    **{
        name: ([_SUBTITLES, _CAPTIONS], True, _CHOOSE)
        for name in (
            "standard", "videomme", "longvideobench", "cinepile", "mlvu", "hourvideo", "mmworld", "egolife", "cgbench",
            "minerva", "mmvu", "standard-flex", "standard-unified",
        )
    },
    "standard_with_audio": ([_SUBTITLES, _CAPTIONS, _AUDIO], True, _CHOOSE),
    "open-ended": ([_SUBTITLES, _CAPTIONS], False, _OPEN),
    "videommlu": ([_SUBTITLES, _CAPTIONS], False, _OPEN),
    "videommmu": ([_SUBTITLES, _CAPTIONS, _FIGURE], True, _CHOOSE),
    "minerva_rubric": ([_SUBTITLES, _CAPTIONS], True, "Explain each step, then name the letter of the best option."),
    "qa-only-flex": ([], True, _CHOOSE),
    "subtitle-only": ([_SUBTITLES], True, _CHOOSE),
    "subtitle-only-flex": ([_SUBTITLES], True, _CHOOSE),
    "caption-only": ([_CAPTIONS], True, _CHOOSE),
    "cgbench_miou": ([_SUBTITLES, _CAPTIONS], False, _INTERVALS),
}


def prompt(kind: str) -> Column:
    """Prompt of an item row; options are left out where a row has none."""
    if kind not in LAYOUTS:
        raise ValueError(f"unknown prompt type: {kind}")
    shown, with_options, request = LAYOUTS[kind]
    parts = [
        F.when(F.length(F.coalesce(F.col(c), F.lit(""))) > 0, F.concat(F.lit(intro), F.col(c))) for c, intro in shown
    ]
    parts.append(F.concat(F.lit("Question: "), F.col("question")))
    if with_options:
        lines = F.transform("options", lambda o, i: F.concat(F.char(i + 65), F.lit(": "), o))
        parts.append(F.when(F.size("options") > 0, F.array_join(lines, "\n")))
    parts.append(F.lit(request))
    return F.array_join(F.array_compact(F.array(*parts)), "\n\n").alias("prompt")


def search_results(found: DataFrame, key: list[str], clip: str, order: str, text: str) -> DataFrame:
    """JSON object per question: ``CLIP_<id>`` to its texts, clips in ascending order.

    ``found`` holds the texts of the few clips a search selected.
    """
    per_clip = found.groupBy(*key, clip).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]).alias("texts")
    )
    entry = F.struct(F.col(clip).alias("c"), F.col("texts").alias("t"))
    packed = per_clip.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("clips"))
    named = F.map_from_entries(
        F.transform("clips", lambda e: F.struct(F.concat(F.lit("CLIP_"), e["c"].cast("string")), e["t"]))
    )
    return packed.select(*key, F.to_json(named).alias("result"))
