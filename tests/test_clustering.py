"""Clusterings against sequential brute force, folded in tasks and merged in tables."""

import numpy as np
import pytest

from cliptide.operators import clustering as C


def recordings(sizes, spread, seed=3, wide=12):
    """Rows (rec, at, vector): chunks scattered around a few speakers, with some exact copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for rec, n in enumerate(sizes):
        middles = rng.normal(size=(5, wide))
        for at in range(n):
            v = middles[rng.integers(5)] + spread * rng.normal(size=wide)
            rows.append((rec, 10 * at, (rows[-2][2] if at % 17 == 16 else [float(x) for x in v])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "rec int, at bigint, v array<double>")


def units(rows):
    v = np.array([r[2] for r in rows])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def by_recording(rows):
    return [[r for r in rows if r[0] == rec] for rec in sorted({r[0] for r in rows})]


def groups_of(df, label):
    found = {}
    for r in df.collect():
        found.setdefault((r.rec, r[label]), set()).add(r.at)
    return {(rec, frozenset(members)) for (rec, _), members in found.items()}


def linkage(rows, floor):
    """One pair at a time, the first of the most similar ones."""
    total, n = units(rows), np.ones(len(rows))
    groups, live = [[i] for i in range(len(rows))], list(range(len(rows)))
    while len(live) > 1:
        sims = np.round(total[live] @ total[live].T / np.outer(n[live], n[live]), 9)
        sims[np.tril_indices(len(live))] = -np.inf
        a, b = np.unravel_index(sims.argmax(), sims.shape)
        if sims[a, b] < floor:
            break
        a, b = live[a], live[b]
        total[a], n[a], groups[a] = total[a] + total[b], n[a] + n[b], groups[a] + groups[b]
        live.remove(b)
    return [groups[i] for i in live]


def as_sets(rows, groups):
    return {(rows[0][0], frozenset(rows[i][1] for i in g)) for g in groups}


@pytest.mark.parametrize(("sizes", "fold"), [([1, 10, 50], 1024), ([10, 50], 24)])
def test_average_linkage(spark, sizes, fold):
    rows = recordings(sizes, 0.7)
    got = C.average_linkage(frame(spark, rows), ["rec"], "at", "v", 0.4, fold)
    want = set()
    for part in by_recording(rows):
        want |= as_sets(part, linkage(part, 0.4))
    assert groups_of(got, "speaker") == want
    for rec in range(len(sizes)):
        firsts = {}
        for r in sorted((r for r in got.collect() if r.rec == rec), key=lambda r: r.at):
            firsts.setdefault(r.speaker, r.at)
        assert list(firsts) == list(range(len(firsts)))


def test_average_linkage_of_500_chunks_in_tables(spark):
    rows = recordings([500], 0.45, wide=16)
    folded, tabled = (groups_of(C.average_linkage(frame(spark, rows), ["rec"], "at", "v", 0.4, fold), "speaker") for fold in (1024, 300))
    assert folded == tabled == as_sets(rows, linkage(rows, 0.4))


def centre_labels(rows, labels, least):
    v, labels = np.array([r[2] for r in rows]), np.array(labels)
    sizes = {c: (labels == c).sum() for c in set(labels.tolist())}
    majors = sorted(c for c, n in sizes.items() if n > least)
    if not majors:
        return [min(sizes)] * len(rows)
    middle = np.array([v[labels == c].mean(0) for c in majors])
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    return [
        int(c) if sizes[c] > least else majors[int(np.argmax(np.round(middle @ (x / np.linalg.norm(x)), 9)))]
        for c, x in zip(labels.tolist(), v, strict=True)
    ]


def merge_labels(rows, labels, floor):
    v, labels = np.array([r[2] for r in rows]), np.array(labels)
    while len(set(labels.tolist())) > 1:
        names = sorted(set(labels.tolist()))
        middle = np.array([v[labels == c].mean(0) for c in names])
        middle /= np.linalg.norm(middle, axis=1, keepdims=True)
        sims = np.triu(np.round(middle @ middle.T, 9), 1) + np.tril(np.full((len(names), len(names)), -9.0))
        a, b = np.unravel_index(sims.argmax(), sims.shape)
        if sims[a, b] < floor:
            break
        labels[labels == names[b]] = names[a]
    return labels.tolist()


@pytest.mark.parametrize("salted", [False, True])
def test_minor_clusters_go_to_the_nearest_centre(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(C, "fits_broadcast", lambda *_: False)
    rows = recordings([60, 9, 3], 0.8)
    labels = [(r[0], r[1], int(7 * k % 11 if k % 3 else 2)) for k, r in enumerate(rows)]
    got = C.without_minor(frame(spark, rows), spark.createDataFrame(labels, "rec int, at bigint, label bigint"), ["rec"], "at", "v", "label")
    want = set()
    for part in by_recording(rows):
        mine = [x[2] for x in labels if x[0] == part[0][0]]
        want |= {(r[0], r[1], c) for r, c in zip(part, centre_labels(part, mine, C.MINOR), strict=True)}
    assert {(r.rec, r.at, r.label) for r in got.collect()} == want


@pytest.mark.parametrize("fold", [1024, 7])
def test_near_centres_are_merged_in_turn(spark, fold):
    rows = recordings([40, 20], 0.9)
    labels = [(r[0], r[1], k % 9) for k, r in enumerate(rows)]
    table = spark.createDataFrame(labels, "rec int, at bigint, label bigint")
    got = C.merged_centres(frame(spark, rows), table, ["rec"], "at", "v", "label", 0.3, fold)
    want = set()
    for part in by_recording(rows):
        mine = [x[2] for x in labels if x[0] == part[0][0]]
        want |= {(r[0], r[1], c) for r, c in zip(part, merge_labels(part, mine, 0.3), strict=True)}
    assert {(r.rec, r.at, r.label) for r in got.collect()} == want


def test_speakers_of_long_and_short_recordings(spark):
    rows = recordings([1, 12, 80], 0.7)
    got = C.speakers(frame(spark, rows), ["rec"], "at", "v", merge_floor=0.5).collect()
    assert len(got) == len(rows)
    for part in by_recording(rows):
        labels = [0] * len(part)
        for k, g in enumerate(sorted(linkage(part, 0.4), key=min)):
            for i in g:
                labels[i] = k
        labels = merge_labels(part, centre_labels(part, labels, C.MINOR), 0.5)
        codes = {}
        want = {r[1]: codes.setdefault(c, len(codes)) for r, c in zip(part, labels, strict=True)}
        assert {r.at: r.speaker for r in got if r.rec == part[0][0]} == want


def careful(rows, threshold):
    sims = np.round(units(rows) @ units(rows).T, 9)
    n = len(rows)
    pairs = sorted((-sims[i, j], i, j) for i in range(n) for j in range(i + 1, n) if sims[i, j] >= threshold)
    group = {i: {i} for i in range(n)}
    for _, i, j in pairs:
        one, two = group[i], group[j]
        if one is not two and min(sims[a, b] for a in one for b in two) >= round(0.9 * threshold, 12):
            one |= two
            for k in two:
                group[k] = one
    return {(rows[0][0], frozenset(rows[k][1] for k in g)) for g in group.values()}


@pytest.mark.parametrize(("sizes", "threshold", "spread", "fold"), [([1, 60], 0.7, 0.6, 1024), ([90], 0.4, 0.9, 1024), ([8, 30], 0.5, 0.8, 10)])
def test_careful_merges(spark, sizes, threshold, spread, fold):
    rows = recordings(sizes, spread)
    got = C.careful_merges(frame(spark, rows), ["rec"], "at", "v", threshold, fold, 24)
    want = set()
    for part in by_recording(rows):
        want |= careful(part, threshold)
    assert groups_of(got, "group") == want


@pytest.mark.parametrize("fold_pairs", [40, 1 << 20])
def test_careful_merges_in_tables_and_by_pairs(spark, fold_pairs):
    rows = recordings([36, 24], 0.8)
    got = C.careful_merges(frame(spark, rows), ["rec"], "at", "v", 0.5, 10, 24, fold_pairs)
    assert groups_of(got, "group") == set().union(*(careful(part, 0.5) for part in by_recording(rows)))


def test_faces_correct_the_speakers(spark):
    """Speaker 0 shows face 1, then face 2, and is divided by sound; speaker 1 shows none and keeps its label."""
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [0.1, 0.1, 1.0]
    audio = [(1, n, 3.0 * n, 3.0 * n + 3, v, s) for n, (v, s) in enumerate([(a, 0), (a, 0), (b, 0), (b, 0), (c, 1), (a, 0)])]
    frames = [(1, n / 4, 1) for n in range(24)] + [(1, 6 + n / 4, 2) for n in range(24)] + [(1, 13.0, 3)]
    faces = C.face_intervals(spark.createDataFrame(frames, "rec int, t double, face int"), ["rec"], "t", "face", 0.3)
    assert sorted(tuple(r) for r in faces.collect()) == [(1, 0.0, 5.75, 1), (1, 6.0, 11.75, 2)]
    table = spark.createDataFrame(audio, "rec int, at bigint, start double, end double, v array<double>, who int")
    got = C.joint_speakers(table, faces, ["rec"], "at", "v", "who", "face").collect()
    assert {r.at: r.speaker for r in got} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 0}


def test_clusters_that_are_near_none_leave_the_tables(spark, monkeypatch):
    # 40 chunks in directions of their own, near none, beside 20 of a few speakers: one round, then a task ends the 20
    rows = [(0, at, [*v, *[0.0] * 40]) for _, at, v in recordings([20], 0.7)]
    rows += [(0, 1000 + k, [float(i == 12 + k) for i in range(52)]) for k in range(40)]
    met, nearest = [], C.nearest_clusters
    monkeypatch.setattr(C, "nearest_clusters", lambda clusters, *rest: met.append(clusters.count()) or nearest(clusters, *rest))
    got = groups_of(C.average_linkage(frame(spark, rows), ["rec"], "at", "v", 0.4, 30), "speaker")
    assert got == as_sets(rows, linkage(rows, 0.4)) and len(got) < 55
    assert len(met) == 1
