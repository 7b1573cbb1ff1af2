"""Record-level plans: embed, select, answer and evaluate JSON-lines questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.config import Experiment
from cliptide.functions import answers as R
from cliptide.functions import models as M
from cliptide.functions import vectors as V
from cliptide.operators import evaluation, nodes as N
from cliptide.plans.select import select_evidence
from cliptide.sources import records as S

ANSWER_RULES = "Use only the evidence given. With options, name the option letter and answer briefly."
JUDGE_RULES = (
    "Decide whether the agent's answer agrees in meaning with the reference answer to the question. "
    "Reply Yes or No only."
)


def embed_records(
    records: DataFrame,
    model: M.Embedder,
    query_field: str = "question",
    documents_field: str = "documents",
    batch: int = 32,
) -> DataFrame:
    """Candidate rows (record_id, clip_id, relevance, vector, …) from documents and a question."""
    question = F.nullif(S.first_of(query_field, "query"), F.lit(""))
    asked = records.select(
        "record_id",
        F.coalesce(question, F.raise_error(F.lit(f"no question in field {query_field}")).cast("string")).alias("question"),
        S.field(documents_field, S.DOCUMENTS).alias("docs"),
    ).dropDuplicates(["record_id"])
    listed = F.when(F.size("docs") > 0, F.col("docs")).otherwise(
        F.raise_error(F.lit(f"no documents in field {documents_field}")).cast(S.DOCUMENTS)
    )
    queries = asked.select("record_id", M.embed(F.col("question"), model, "query", batch).alias("query_vector"))
    docs = asked.select("record_id", F.posexplode(listed).alias("seq", "d")).select(
        "record_id", "seq", "d.*"
    ).withColumn("vector", M.embed(F.col("text"), model, "document", batch))
    return docs.join(queries, "record_id").select(
        "record_id",
        "seq",
        F.coalesce("clip_id", F.col("seq").cast("string")).alias("clip_id"),
        V.dot(V.normalize(F.col("vector")), V.normalize(F.col("query_vector"))).alias("relevance"),
        "vector",
        "text",
        "start",
        "end",
    )


def select_records(records: DataFrame, experiment: Experiment, scored: DataFrame | None = None) -> DataFrame:
    """Selected evidence per record beside the record's other fields.

    Candidates come from the records (or from ``scored``, e.g. freshly embedded ones). Equal
    records are decided once and joined back.
    """
    distinct = records.dropDuplicates(["record_id"])
    shape = ["record_id", "clip_id", "relevance", "vector", "text", "start", "end"]
    if scored is None:
        scored = S.candidates(distinct).select(*shape)
        if experiment.nodes is not None:
            node_rows = S.nodes(distinct, True)
            folded = N.aggregate_nodes(node_rows, ["record_id"], experiment.nodes)
            scored = scored.unionByName(
                folded.select(*[F.col(c).cast(scored.schema[c].dataType).alias(c) for c in shape])
            )
        else:
            missing = S.nodes(distinct, False).select(*shape)
            scored = scored.unionByName(missing)
    chosen = select_evidence(scored.select(*shape), ["record_id"], experiment.plan)
    evidence = F.transform(
        "selected",
        lambda s: F.struct(
            s["clip_id"].alias("clip_id"),
            s["relevance"].alias("relevance"),
            s["facts"]["text"].alias("text"),
            s["facts"]["start"].alias("start"),
            s["facts"]["end"].alias("end"),
        ),
    )
    slim = chosen.select(
        "record_id",
        F.col("selected_k"),
        F.transform("selected", lambda s: s["clip_id"]).alias("selected_clip_ids"),
        evidence.alias("selected_evidence"),
        F.struct("stop_reason", F.col("mmr_order").alias("selected_mmr_order"), "mmr_steps").alias("trace"),
    )
    joined = records.select("record_id", S.passthrough("candidates", "nodes", "documents").alias("passthrough")).join(
        slim, "record_id", "left"
    )
    empty = F.array().cast("array<string>")
    return joined.select(
        "record_id",
        "passthrough",
        F.lit(experiment.name).alias("experiment"),
        F.lit(experiment.method).alias("method"),
        F.coalesce("selected_k", F.lit(0)).alias("selected_k"),
        F.coalesce("selected_clip_ids", empty).alias("selected_clip_ids"),
        "selected_evidence",
        "trace",
    )


def format_evidence(evidence: Column) -> Column:
    """Evidence blocks with clip id and times to one decimal, blank lines between."""
    def block(e: Column) -> Column:
        begin = F.when(e["start"].isNotNull(), F.format_string(" | %.1fs", e["start"])).otherwise(F.lit(""))
        until = F.when(e["start"].isNotNull() & e["end"].isNotNull(), F.format_string("-%.1fs", e["end"])).otherwise(
            F.lit("")
        )
        return F.concat(F.lit("[Clip "), e["clip_id"], begin, until, F.lit("]\n"), F.coalesce(e["text"], F.lit("")))

    return F.array_join(F.transform(evidence, block), "\n\n")


def answer_records(selected: DataFrame, model: M.Chat, question: Column, options: Column) -> DataFrame:
    """Prediction per record from its evidence."""
    prompt = F.concat(
        F.lit("Question: "),
        R.build_query(question, options),
        F.lit("\n\nEvidence:\n"),
        F.coalesce(format_evidence(F.col("selected_evidence")), F.lit("")),
        F.lit("\n\nAnswer:"),
    )
    return selected.withColumn("prediction", M.chat(prompt, model, ANSWER_RULES))


def evaluate_records(
    rows: DataFrame, mode: str, judge: M.Chat | None = None, selected: str = "selected_k"
) -> tuple[DataFrame, DataFrame]:
    """Graded rows and their metrics; ``rows`` holds question, prediction and ground_truth."""
    if mode == "multiple_choice":
        correct = R.extract_option(F.col("prediction")) == R.extract_option(F.col("ground_truth"))
    elif mode == "exact":
        correct = R.normalize_plain(F.col("prediction")) == R.normalize_plain(F.col("ground_truth"))
    elif mode == "judge":
        if judge is None:
            raise ValueError("mode judge needs a judge model")
        prompt = F.concat(
            F.lit("Question: "), F.coalesce("question", F.lit("")),
            F.lit("\nReference: "), F.coalesce("ground_truth", F.lit("")),
            F.lit("\nAgent: "), F.coalesce("prediction", F.lit("")),
        )
        rows = rows.withColumn("judge_response", F.trim(M.chat(prompt, judge, JUDGE_RULES, 0.0, 4)))
        correct = M.judged_yes(F.col("judge_response"))
    else:
        raise ValueError(f"unknown evaluation mode: {mode}")
    graded = rows.withColumn("correct", correct)
    return graded, evaluation.accuracy(graded, "correct", selected if selected in rows.columns else None)
