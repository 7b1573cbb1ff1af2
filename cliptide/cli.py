"""Command line: select, embed, answer and evaluate JSON-lines files."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import functions as F

from cliptide import config
from cliptide.functions import models as M
from cliptide.plans import records as P
from cliptide.session import get_session
from cliptide.sources import records as S


def _key(name: str) -> str:
    return os.environ.get(name, "")


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cliptide")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("select", "embed", "answer", "evaluate"):
        sub = verbs.add_parser(verb)
        sub.add_argument("--input", required=True)
        sub.add_argument("--output", required=verb != "evaluate")
        sub.add_argument("--api-key-env", default="OPENAI_API_KEY")
        if verb == "select":
            sub.add_argument("--config", required=True)
        if verb == "embed":
            sub.add_argument("--backend", choices=["hashing", "http"], default="hashing")
            sub.add_argument("--query-field", default="question")
            sub.add_argument("--documents-field", default="documents")
            sub.add_argument("--batch-size", type=int, default=32)
        if verb == "answer":
            sub.add_argument("--backend", choices=["echo", "http"], default="echo")
        if verb == "evaluate":
            sub.add_argument("--mode", choices=["multiple_choice", "exact", "judge"], required=True)
            sub.add_argument("--metrics")
            sub.add_argument("--backend", choices=["echo", "http"], default="echo")
        if verb != "select":
            sub.add_argument("--model", default="")
            sub.add_argument("--base-url", default="http://127.0.0.1:8000")
    return parser


def _chat(args: argparse.Namespace) -> M.Chat:
    if args.backend == "http":
        return M.HttpChat(args.base_url, args.model, _key(args.api_key_env))
    return M.EchoChat()


def main(argv: list[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    spark = get_session("cliptide")
    records = S.read_records(spark, args.input)
    if args.verb == "select":
        out = P.select_records(records, config.from_yaml(args.config))
        S.write_records(out, args.output)
    elif args.verb == "embed":
        model = M.HttpEmbedder(args.base_url, args.model, _key(args.api_key_env)) if args.backend == "http" else M.HashingEmbedder()
        S.write_records(
            P.embed_records(records, model, args.query_field, args.documents_field, args.batch_size), args.output
        )
    elif args.verb == "answer":
        rows = records.select(
            "record_id",
            S.first_of("question", "query", "passthrough.question").alias("question"),
            S.field("options", "array<string>").alias("options"),
            S.field("selected_evidence", S.CANDIDATES).alias("selected_evidence"),
        )
        S.write_records(P.answer_records(rows, _chat(args), F.col("question"), F.col("options")), args.output)
    else:
        rows = records.select(
            "record_id",
            S.first_of("question", "query").alias("question"),
            S.first_of("prediction", "answer").alias("prediction"),
            S.first_of("ground_truth", "ground_truth_answer").alias("ground_truth"),
            S.field("selected_k", "int").alias("selected_k"),
        )
        graded, metrics = P.evaluate_records(rows, args.mode, _chat(args) if args.mode == "judge" else None)
        if args.output:
            S.write_records(graded, args.output)
        if args.metrics:
            S.write_records(metrics, args.metrics)
        metrics.show(truncate=False)


if __name__ == "__main__":
    main()
