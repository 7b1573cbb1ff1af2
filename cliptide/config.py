"""Experiment settings: selector limits and node aggregation."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from typing import Any

from cliptide.operators.nodes import NodeSettings
from cliptide.plans.select import STANDALONE, SelectionPlan

#: Method names that settings files may carry.
METHODS = ("calibrated",)


@dataclass(frozen=True)
class Experiment:
    """A named selector run. ``nodes`` is None when records may not hold memory nodes."""

    name: str = "calibrated"
    method: str = "calibrated"
    plan: SelectionPlan = STANDALONE
    nodes: NodeSettings | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        p = self.plan
        return {
            "name": self.name,
            "method": self.method,
            "candidate_pool": p.candidate_pool,
            "min_k": p.min_k,
            "max_k": p.max_k,
            "start_k": p.start_k,
            "lambda": p.lambda_,
            "temporal_output": p.output_order == "time",
            "structured_memory": {"enabled": self.nodes is not None, **(asdict(self.nodes) if self.nodes else {})},
        }


def from_mapping(value: dict[str, Any]) -> Experiment:
    """Build and check an experiment; unknown keys are errors."""
    data = dict(value)
    structured = dict(data.pop("structured_memory", None) or {})
    enabled = bool(structured.pop("enabled", False))
    if "leader_weights" in structured:
        structured["leader_weights"] = tuple(float(w) for w in structured["leader_weights"])
    settings = NodeSettings(**structured)
    name, method = data.pop("name", "calibrated"), data.pop("method", "calibrated")
    if "lambda" in data:
        data["lambda_"] = data.pop("lambda")
    order = "time" if data.pop("temporal_output", True) else "rank"
    unknown = set(data) - {"candidate_pool", "min_k", "max_k", "start_k", "lambda_"}
    if unknown:
        raise TypeError(f"unknown settings: {sorted(unknown)}")
    plan = replace(STANDALONE, output_order=order, **data)
    check(method, plan)
    return Experiment(name, method, plan, settings if enabled else None)


def check(method: str, plan: SelectionPlan) -> None:
    """Raise ValueError for settings outside their range."""
    rules = [
        (method in METHODS, f"the method must be one of {METHODS}"),
        (plan.candidate_pool > 0, "candidate_pool must be positive"),
        (0 < plan.min_k <= plan.max_k, "expected 0 < min_k <= max_k"),
        (1 <= plan.start_k <= plan.max_k, "start_k must lie between 1 and max_k"),
        (0.0 <= plan.lambda_ <= 1.0, "lambda must lie in [0, 1]"),
    ]
    for holds, message in rules:
        if not holds:
            raise ValueError(message)


def from_yaml(path: str | Path) -> Experiment:
    import yaml

    payload = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(payload, dict):
        raise ValueError(f"settings must be a mapping: {path}")
    return from_mapping(payload)
