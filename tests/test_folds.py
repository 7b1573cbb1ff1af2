"""Clusterings that one task ends, against one pair at a time; their memory."""

import tracemalloc

import numpy as np
import pytest

from cliptide.operators import clustering as C
from cliptide.operators import folds
from tests.test_clustering import as_sets, careful, frame, groups_of, linkage, recordings


def vectors(seed):
    """Unit vectors: scattered, around four speakers, on a grid (many equal scores) or half of them near copies."""
    rng = np.random.default_rng(seed)
    n, wide = int(rng.integers(1, 80)), int(rng.integers(3, 16))
    v = rng.normal(size=(n, wide))
    if seed % 4 == 1:
        v = v[rng.integers(min(4, n), size=n)] + 0.5 * rng.normal(size=(n, wide))
    elif seed % 4 == 2:
        v = rng.integers(-1, 2, size=(n, wide)).astype(float)
        v[~v.any(1)] = 1
    elif seed % 4 == 3:
        v[: n // 2] = v[0] + 0.05 * rng.normal(size=(n // 2, wide))
    v = np.unique(v / np.linalg.norm(v, axis=1, keepdims=True), axis=0)
    return v[rng.permutation(len(v))]


def small_blocks(monkeypatch, seed):
    for name, value in (("BLOCK_SCORES", 50 + seed), ("SLOTS", 1 + seed % 3), ("KEPT_MEMBERS", 1 + seed % 5), ("KEPT_BYTES", 16 * 80 * (seed % 4))):
        monkeypatch.setattr(folds, name, value, raising=False)


def first_of(groups, n):
    out = np.zeros(n, int)
    for g in groups:
        out[g] = min(g)
    return out.tolist()


@pytest.mark.parametrize("seed", range(40))
def test_linked_like_one_pair_at_a_time(monkeypatch, seed):
    if seed % 3:
        small_blocks(monkeypatch, seed)
    v, floor = vectors(seed), (0.2, 0.5, -0.3)[seed % 3]
    rows = [(0, k, x.tolist()) for k, x in enumerate(v)]
    assert folds.linked(v, np.ones(len(v)), floor).tolist() == first_of(linkage(rows, floor), len(v))


@pytest.mark.parametrize("seed", range(40))
def test_careful_like_one_pair_at_a_time(monkeypatch, seed):
    if seed % 3:
        small_blocks(monkeypatch, seed)
    v, threshold = vectors(seed), (0.2, 0.5, -0.3, 0.9)[seed // 4 % 4]
    rows = [(0, k, x.tolist()) for k, x in enumerate(v)]
    got = folds.careful(v, threshold, round(C.KEPT_SHARE * threshold, 12))
    assert {(0, frozenset(np.flatnonzero(got == g).tolist())) for g in got.tolist()} == careful(rows, threshold)


def test_scaled_copies_are_settled_by_their_first_rows(monkeypatch):
    """Cosines of one to nine digits: every pair of the copies is a tie, and a hub takes them one by one without computing all rows again."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(90, 8))
    v[rng.choice(90, 60, replace=False)] = rng.normal(size=8) * rng.uniform(0.5, 2, size=(60, 1))
    v = (v.astype(np.float32) / np.linalg.norm(v, axis=1, keepdims=True)).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows, asked, blocks = [(0, k, x.tolist()) for k, x in enumerate(v)], [], folds._blocks
    monkeypatch.setattr(folds, "_blocks", lambda part, width: asked.append(len(part)) or blocks(part, width))
    assert folds.linked(v, np.ones(90), 0.5).tolist() == first_of(linkage(rows, 0.5), 90)
    assert sum(asked) < 6 * 90
    got = folds.careful(v, 0.5, 0.45)
    assert {(0, frozenset(np.flatnonzero(got == g).tolist())) for g in got.tolist()} == careful(rows, 0.5)


def test_careful_leaves_a_vector_without_numbers_alone():
    v = np.array([[1.0, 0.0], [0.8, 0.6], [np.nan, np.nan], [0.0, 1.0]])
    assert folds.careful(v, 0.7, 0.63).tolist() == [0, 0, 2, 3]


@pytest.mark.parametrize("fold", [lambda v: folds.linked(v, np.ones(len(v)), 0.5), lambda v: folds.careful(v, 0.5, 0.45)])
def test_folds_hold_no_scores_of_all_pairs(monkeypatch, fold):
    monkeypatch.setattr(folds, "BLOCK_SCORES", 1 << 16)
    monkeypatch.setattr(folds, "KEPT_BYTES", 1 << 20)
    v = np.random.default_rng(0).normal(size=(3000, 16))
    v[:400] = v[0] + 0.02 * v[:400]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tracemalloc.start()
    try:
        fold(v)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8_000_000  # all scores are 72 MB


def test_a_recording_of_1200_clusters_needs_no_rounds_of_tables(spark, monkeypatch):
    rows = recordings([1200], 0.8, wide=16)
    monkeypatch.setattr(C, "nearest_clusters", lambda *_: pytest.fail("a round of tables"))
    assert groups_of(C.average_linkage(frame(spark, rows), ["rec"], "at", "v", 0.8), "speaker") == as_sets(rows, linkage(rows, 0.8))


def test_a_graph_of_1200_directions_forms_no_table_of_pairs(spark, monkeypatch):
    rows = recordings([1200], 0.8, wide=16)
    monkeypatch.setattr(C.graph, "block_pairs", lambda *_: pytest.fail("a table of pairs"))
    assert groups_of(C.careful_merges(frame(spark, rows), ["rec"], "at", "v", 0.6), "group") == careful(rows, 0.6)
