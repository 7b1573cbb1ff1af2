"""Runnable queries over the bundled tables, each beside its independent SQL check."""

from cliptide.catalog import answers, clusters, depths, details, grading, graphs, memory, ranks, relations, selection, streams, texts, timeline  # noqa: F401
from cliptide.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
