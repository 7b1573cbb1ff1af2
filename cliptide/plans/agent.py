"""Multi-round question answering: search or answer, with the found clips carried along."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.functions import answers as R
from cliptide.session import cut_lineage

Search = Callable[[DataFrame, DataFrame], DataFrame]
Reply = Callable[[DataFrame, bool], DataFrame]


def run_rounds(questions: DataFrame, key: str, reply: Reply, search: Search, rounds: int = 5) -> DataFrame:
    """Answer every question within ``rounds``; the last round must answer.

    ``reply(open, last)`` adds a ``response`` column to the open questions (key, question, query,
    evidence). ``search(asked, seen)`` returns (key, clip_id, text) for the asked queries; clips
    in ``seen`` (key, clip_id) are left out of its result here. Only open questions go on, and
    each round is stored in the checkpoint folder, so a lost executor redoes one round at most.
    """
    empty = F.array().cast("array<string>")
    still = cut_lineage(
        questions.select(key, "question", F.col("question").alias("query"), empty.alias("evidence"))
    )
    seen = None
    answers = None
    for n in range(1, rounds + 1):
        last = n == rounds
        acted = cut_lineage(reply(still, last).withColumn("act", R.agent_action(F.col("response"))))
        answered = F.lit(True) if last else (F.col("act.action") == "Answer")
        done = acted.filter(answered).select(
            key, F.coalesce("act.content", "response").alias("answer"), F.lit(n).alias("rounds"), "evidence"
        )
        answers = done if answers is None else answers.unionByName(done)
        asked = acted.filter(~answered).select(
            key, "question", F.coalesce("act.content", "question").alias("query"), "evidence"
        )
        if last or asked.isEmpty():
            break
        found = search(asked, seen) if seen is not None else search(asked, asked.select(key, F.lit(None).cast("string").alias("clip_id")))
        if seen is not None:
            found = found.join(seen, [key, "clip_id"], "left_anti")
        found = cut_lineage(found.select(key, "clip_id", "text"))
        fresh = found.groupBy(key).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("clip_id", "text"))), lambda s: s["text"]).alias("fresh")
        )
        still = asked.join(fresh, key, "left").select(
            key, "question", "query", F.concat("evidence", F.coalesce("fresh", empty)).alias("evidence")
        )
        clips = found.select(key, "clip_id")
        seen = clips if seen is None else seen.unionByName(clips)
        still, seen = cut_lineage(still), cut_lineage(seen)
    return answers
