"""Evidence retrieval, selection and evaluation over time-ordered memories on Spark."""

from cliptide.config import Experiment, from_mapping, from_yaml
from cliptide.operators.depth import DepthParams, calibrated_depth, policy
from cliptide.operators.mmr import greedy_prefix
from cliptide.operators.nodes import NodeSettings, aggregate_nodes
from cliptide.operators.scoring import candidate_pool, score_against
from cliptide.plans.select import CAPTION_HOST, GRAPH_HOST, STANDALONE, STANDALONE_GRAPH, SelectionPlan, select_evidence
from cliptide.session import get_session

__all__ = [
    "CAPTION_HOST",
    "DepthParams",
    "Experiment",
    "GRAPH_HOST",
    "NodeSettings",
    "STANDALONE",
    "STANDALONE_GRAPH",
    "SelectionPlan",
    "aggregate_nodes",
    "calibrated_depth",
    "candidate_pool",
    "from_mapping",
    "from_yaml",
    "get_session",
    "greedy_prefix",
    "policy",
    "score_against",
    "select_evidence",
]
