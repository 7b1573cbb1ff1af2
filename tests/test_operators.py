import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cliptide.functions import answers as R
from cliptide.functions import arrays as A
from cliptide.functions import text as X
from cliptide.functions import times as T
from cliptide.functions import vectors as V
from cliptide.operators import carry, coverage, depth, evaluation, identity, intervals, metrics, mmr, speakers
from cliptide.operators import graph as G
from cliptide.operators.carry import Running
from cliptide.operators.depth import DepthParams
from cliptide.plans import select


def one(spark, column, **values):
    names = ", ".join(f"{v} as {k}" for k, v in values.items()) or "1 as x"
    return spark.sql(f"select {names}").select(column.alias("out")).first()[0]


def pool(spark, rows):
    return spark.createDataFrame(rows, "q string, clip_id string, relevance double, start double, vector array<double>")


BASE = [("q", str(i), r, float(i), v) for i, (r, v) in enumerate([(0.9, [1.0, 0.0]), (0.8, [0.9, 0.1]), (0.5, [0.0, 1.0]), (0.1, [-1.0, 0.2])])]


def reference_walk(rel, vecs, steps, lam):
    """Plain greedy loop, recomputing every redundancy."""
    rel = np.asarray(rel, float)
    span = max(rel.max() - rel.min(), 1e-12)
    rel = (rel - rel.min()) / span
    vecs = [np.asarray(v, float) / max(np.linalg.norm(v), 1e-300) for v in vecs]
    chosen = []
    while len(chosen) < min(steps, len(rel)):
        def score(i):
            red = max((float(vecs[i] @ vecs[j]) for j in chosen), default=0.0)
            s = rel[i] if not chosen else lam * rel[i] - (1 - lam) * red
            return (round(s, 9), round(rel[i], 9), -i)
        chosen.append(max((i for i in range(len(rel)) if i not in chosen), key=score))
    return chosen


@pytest.mark.parametrize("lam", [0.0, 0.5, 1.0])
def test_greedy_matches_plain_loop(spark, lam):
    rng = np.random.default_rng(3)
    rel = rng.random(30).round(2).tolist()
    vecs = rng.normal(size=(30, 5)).tolist()
    rows = [("q", f"{i:02d}", r, float(i), v) for i, (r, v) in enumerate(zip(rel, vecs))]
    order = sorted(range(30), key=lambda i: (-rel[i], i))
    cut = pool(spark, [rows[i] for i in order])
    placed = spark.createDataFrame(
        [(*rows[i], n + 1) for n, i in enumerate(order)], cut.schema.add("pos", IntegerType())
    )
    got = [r.clip_id for r in mmr.greedy_prefix(placed, ["q"], 8, lam).orderBy("rank").collect()]
    want = reference_walk([rel[i] for i in order], [vecs[i] for i in order], 8, lam)
    assert got == [f"{order[w]:02d}" for w in want]


def test_lambda_outside_range(spark):
    rows = pool(spark, BASE).withColumn("pos", F.lit(1))
    with pytest.raises(ValueError):
        mmr.greedy_prefix(rows, ["q"], 3, 1.1)
    assert mmr.greedy_prefix(rows, ["q"], 3, 1.1, clip_lambda=True).count() == 3


def test_select_edge_cases(spark):
    assert select.select_evidence(pool(spark, []), ["q"]).count() == 0
    single = select.select_evidence(pool(spark, BASE[:1]), ["q"]).first()
    assert (single.selected_k, single.stop_reason) == (1, "no_valid_boundary_return_max")
    equal = pool(spark, [(q, c, 0.5, s, v) for q, c, _, s, v in BASE])
    # all equal: first score 0 stand-alone, 1 in the graph variant
    assert select.select_evidence(equal, ["q"]).first().curve[0] == 0.0
    assert select.select_evidence(equal, ["q"], select.GRAPH_HOST).first().curve[0] == 1.0
    zero = pool(spark, [*BASE[:2], ("q", "9", 0.7, None, [0.0, 0.0])])
    picked = select.select_evidence(zero, ["q"], select.with_policy(select.STANDALONE, "top_k")).first()
    assert [s.clip_id for s in picked.selected] == ["0", "1", "9"]  # null start last
    ids = pool(spark, [("q", "2", 0.5, 1.0, [1.0, 0.0]), ("q", "10", 0.5, 1.0, [0.0, 1.0])])
    assert [s.clip_id for s in select.select_evidence(ids, ["q"]).first().selected] == ["10", "2"]
    assert [s.clip_id for s in select.select_evidence(ids, ["q"], select.GRAPH_HOST).first().selected] == ["2", "10"]


def test_calibrated_depth_reasons(spark):
    def run(values, **kw):
        row = one(spark, depth.calibrated_depth(F.col("c"), **kw), c=f"cast(array({values}) as array<double>)")
        return row.k, row.reason
    assert run("") == (0, "empty_candidates")
    assert run("1.0, 1.1, 1.2, 1.3") == (4, "no_positive_drop_return_max")
    assert run("-0.1, -0.2, -0.3") == (3, "no_valid_boundary_return_max")
    assert run("1.0, 0.9, 0.2, 0.1") == (2, "calibrated_adjacent_drop")
    assert run("1.0, 0.1", min_k=5) == (2, "no_valid_boundary_return_max")
    assert run("1.0, 0.1, 0.05", start_k=1, min_k=2) == (2, "calibrated_adjacent_drop")


def test_every_policy_stays_in_range(spark):
    rng = np.random.default_rng(5)
    rows = [(i, sorted(rng.random(n).round(3).tolist(), reverse=True)) for i, n in enumerate([1, 2, 3, 5, 9, 40])]
    rows += [(10, [0.5] * 6), (11, [0.1, 0.9, 0.2, 0.8]), (12, [-0.1, -0.2, -0.4])]
    df = spark.createDataFrame(rows, "id int, curve array<double>")
    p = DepthParams()
    cols = [depth.policy(n, F.col("curve"), p).alias(n) for n in depth.POLICIES]
    cols += [depth.policy(n, F.col("curve"), p, F.col("curve"), F.col("curve")).alias(n) for n in depth.TRACE_POLICIES]
    for row in df.select(F.size("curve").alias("n"), *cols).collect():
        for name in row.asDict():
            assert name == "n" or 1 <= row[name] <= min(5, row["n"]), (name, row)


def test_erf(spark):
    for x in (-6.0, -1.3, 0.0, 0.2, 2.5, 4.9):
        assert one(spark, A.erf(F.lit(x))) == pytest.approx(math.erf(x), abs=1e-12)


def test_array_statistics(spark):
    data = [0.3, 0.1, 0.9, 0.4]
    col = "array(0.3D, 0.1D, 0.9D, 0.4D)"
    assert one(spark, A.median(F.col("a")), a=col) == pytest.approx(np.median(data))
    assert one(spark, A.quantile(F.col("a"), 0.6), a=col) == pytest.approx(np.quantile(data, 0.6))
    assert one(spark, A.std(F.col("a")), a=col) == pytest.approx(np.std(data))
    assert one(spark, A.running_min(F.col("a")), a=col) == [0.3, 0.1, 0.1, 0.1]


def events(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        start = int(rng.integers(0, 5000))
        rows.append((int(rng.integers(0, 2)), i, start, start + int(rng.integers(0, 30)), "ab"[int(rng.integers(0, 2))]))
    return spark.createDataFrame(rows, "k int, id int, start bigint, end bigint, who string")


def both_ways(monkeypatch, build):
    """Result with plain windows and with the chunked path forced."""
    plain = sorted(map(tuple, build().collect()))
    monkeypatch.setattr(carry, "HOT_ROWS", 0)
    chunked = sorted(map(tuple, build().collect()))
    monkeypatch.undo()
    return plain, chunked


def test_chunked_windows_equal_plain_windows(spark, monkeypatch):
    df = events(spark)
    chunk = F.floor(F.col("start") / 97)
    for build in (
        lambda: intervals.merge_intervals(df, ["k"], "id", chunk),
        lambda: intervals.merge_turns(df, ["k"], "who", "id", chunk, 5),
        lambda: intervals.dialogue_links(df, ["k"], "who", "id", chunk, 5),
        lambda: intervals.next_at_or_after(df.select("k", "start").distinct(), df.filter("who = 'a'").select("k", F.col("end").alias("e")), ["k"], "start", "e", 97),
        lambda: speakers.split_overlaps(
            df.select("k", "id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.ascii("who").alias("speaker")),
            ["k"], "id", chunk,
        ),
    ):
        plain, chunked = both_ways(monkeypatch, build)
        assert plain == chunked and plain


def test_running_kinds_both_directions(spark):
    df = spark.createDataFrame([(1, i, (i * 7) % 5 if i % 3 else None) for i in range(60)], "k int, i int, x int")
    specs = {n: Running(n, F.col("x"), inclusive=inc) for n, inc in (("sum", True), ("min", False), ("max", True), ("last", False), ("count", True))}
    for down in (False, True):
        plain = carry.running(df, ["k"], ["i"], None, specs, down).orderBy("i").collect()
        chunked = carry.running(df, ["k"], ["i"], F.floor(F.col("i") / 7), specs, down).orderBy("i")
        assert [r.asDict() for r in chunked.select(plain[0].__fields__).collect()] == [r.asDict() for r in plain]
    whole = carry.running(df, [], ["i"], F.floor(F.col("i") / 7), {"n": Running("count", F.lit(1))})
    assert [r.n for r in whole.orderBy("i").collect()] == list(range(1, 61))


def test_overlap_join_is_exact(spark):
    df = events(spark, 200, 4)
    got = {(r.l_id, r.r_id) for r in intervals.overlap_join(df, df, ["k"], ("start", "end"), 13).collect()}
    rows = df.collect()
    want = {(a.id, b.id) for a in rows for b in rows if a.k == b.k and a.start < b.end and b.start < a.end}
    assert got == want


def brute_components(ids, pairs):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components_of_a_chain_and_a_hub(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, j) for j in range(101, 130)]
    edges = spark.createDataFrame([(0, a, b) for a, b in pairs], "g int, src int, dst int")
    got = {r.node_id: r.root for r in G.connected_components(edges, ["g"]).collect()}
    want = brute_components({i for p in pairs for i in p}, pairs)
    assert got == want


def test_similarity_forest_in_small_blocks(spark):
    rng = np.random.default_rng(9)
    vecs = rng.normal(size=(120, 4))
    vecs[50:60] = vecs[3]  # a group of copies
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(vecs)], "g int, id int, v array<double>")
    found = G.similarity_forest(df, ["g"], "id", "v", 0.97, block_rows=8)
    got = {r.node_id: r.root for r in G.connected_components(found, ["g"]).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    pairs = [(i, j) for i in range(120) for j in range(i) if sims[i, j] >= 0.97]
    want = brute_components(range(120), pairs)
    assert {i: got.get(i, i) for i in range(120)} == want


def test_one_to_one_equals_greedy(spark):
    rng = np.random.default_rng(2)
    rows = [(0, int(rng.integers(0, 12)), int(rng.integers(0, 12)), float(rng.integers(0, 6)), i) for i in range(90)]
    df = spark.createDataFrame(rows, "g int, a int, b int, s double, id int")
    got = {(r.a, r.b) for r in G.one_to_one(df, ["g"], "a", "b", [-F.col("s")], "id").collect()}
    want, ua, ub = set(), set(), set()
    for _, a, b, s, i in sorted(rows, key=lambda r: (-r[3], r[4])):
        if a not in ua and b not in ub:
            want.add((a, b)); ua.add(a); ub.add(b)
    assert got == want


def test_sign_test(spark):
    def exact(w, l):
        n, k = w + l, min(w, l)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
    for w, l in ((0, 0), (5, 1), (30, 12), (200, 260), (7, 7)):
        assert one(spark, evaluation.sign_test(F.lit(w), F.lit(l))) == pytest.approx(exact(w, l), rel=1e-9)
    assert 0 < one(spark, evaluation.sign_test(F.lit(500_000_000), F.lit(500_050_000))) < 1


def test_times(spark):
    sec = lambda s: one(spark, T.parse_seconds(F.lit(s)))
    assert sec("01:02:03,5") == 3723.5 and sec("12.5") == 12.5 and sec("1:2") is None and sec("x") is None and sec("") is None
    assert one(spark, T.format_seconds(F.lit(3599.5))) == "01:00:00" and one(spark, T.format_seconds(F.lit(2.5))) == "00:00:02"
    assert one(spark, T.format_seconds(F.lit(None).cast("double"))) == "" and one(spark, T.format_seconds(F.lit(-5.0))) == "00:00:00"
    assert one(spark, T.clock_to_ms(F.lit("01:05"))) == 65000 and one(spark, T.clock_to_ms(F.lit("oops"))) == 0
    ok = lambda a, b: one(spark, T.valid_segment(F.lit(a), F.lit(b), F.lit(100)))
    assert ok("00:10", "00:20") and not ok("00:20", "00:10") and not ok("00:61", "01:30") and not ok("00:10", "02:00")
    got = one(spark, T.overlapping_chunks(*[F.lit(v).cast("bigint") for v in (0, 4000, 1500, 750)]))
    assert [(c.start, c.end) for c in got] == [(0, 1500), (750, 2250), (1500, 3000), (2250, 3750), (3000, 4000)]


def test_answers(spark):
    opt = lambda s: one(spark, R.extract_option(F.lit(s)))
    assert [opt(s) for s in ("b", "(C) text", "Answer: d", "Apple", "")] == ["B", "C", "D", "", ""]
    pick = lambda s, **k: one(spark, R.choice_letter(F.lit(s), **k))
    assert pick("A. or maybe B. yes") == "B" and pick("A. or maybe B.") == "A" and pick("(C)") == "C" and pick("API Error") == "" and pick("nothing") == ""
    assert pick("A: x. then B. ok") == "B" and pick("A\n", exclusive=True) == "A"
    options = F.create_map(F.lit("A"), F.lit("Red car"), F.lit("B"), F.lit("Blue"))
    full = lambda s: one(spark, R.choice_with_options(F.lit(s), options))
    assert full("option b") == "B" and full("Red car, surely") == "A" and full("none") is None
    assert one(spark, R.route_label(F.lit("multi-step please"))) == "C" and one(spark, R.route_label(F.lit("?"), None)) == ""
    act = one(spark, R.agent_action(F.lit("<think>x</think> Action: [Search]\nContent: where")))
    assert (act.action, act.content) == ("Search", "where")
    assert one(spark, X.normalize_answer(F.lit("The cat, and A dog!"))) == "cat dog"
    assert one(spark, X.stem(F.lit("walking"))) == "walk" and one(spark, X.stem(F.lit("bed"))) == "bed"
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_saturation_stops_and_roles_cover(spark):
    schema = "q string, pos int, clip_id bigint, relevance double, vector array<double>, centroids array<array<double>>, entities array<string>, words array<string>, actions array<string>"
    rows = [
        ("q", 1, 0, 1.0, [1.0, 0.0], [[1.0, 0.0]], ["e1"], ["w"], ["walk"]),
        ("q", 2, 1, 0.9, [1.0, 0.0], [[1.0, 0.0]], ["e1"], ["w"], ["walk"]),
        ("q", 3, 9, 0.2, [0.0, 1.0], [[0.0, 1.0]], ["e2"], ["v"], ["sit"]),
    ]
    got = coverage.saturation_prefix(spark.createDataFrame(rows, schema), ["q"]).orderBy("rank").collect()
    # the near copy adds nothing new and costs redundancy; the distant clip brings new evidence
    assert [r.clip_id for r in got] == [0, 1] or [r.clip_id for r in got][0] == 0
    weights = F.create_map(F.lit("action_event"), F.lit(1.0), F.lit("spatial_location"), F.lit(1.0))
    units = "q string, pos int, clip_id string, relevance double, vector array<double>, units array<struct<unit string, role string>>"
    pool_rows = [
        ("q", 1, "a", 1.0, [1.0, 0.0], [("u1", "action_event")]),
        ("q", 2, "b", 0.9, [1.0, 0.0], [("u1", "action_event")]),
        ("q", 3, "c", 0.5, [0.0, 1.0], [("u2", "spatial_location")]),
    ]
    df = spark.createDataFrame(pool_rows, units).withColumn("weights", weights)
    assert [r.clip_id for r in coverage.role_prefix(df, ["q"], 2).orderBy("rank").collect()] == ["a", "c"]


def test_split_overlaps_against_a_plain_loop(spark):
    rng = np.random.default_rng(11)
    rows, at = [], 0.0
    for i in range(300):
        at = round(at + float(rng.integers(0, 4)), 1)
        rows.append((1, i, at, at + float(rng.integers(1, 4)), int(rng.integers(0, 2))))
    df = spark.createDataFrame(rows, "r int, id int, start double, end double, speaker bigint")
    got = sorted((x.start, x.end, x.speaker) for x in speakers.split_overlaps(df, ["r"], "id", F.floor(F.col("start") / 10)).collect())
    want = []
    for _, _, start, end, who in sorted(rows, key=lambda x: (x[2], x[1])):
        if want and who == want[-1][2] and start <= want[-1][1]:
            want[-1][1] = end
        else:
            if want and start < want[-1][1]:
                want[-1][1] = start = (want[-1][1] + start) / 2
            want.append([start, end, who])
    assert got == sorted(map(tuple, want))


def test_resolve_nodes(spark):
    from cliptide.operators import identity as I

    items = spark.createDataFrame([(0, 1, "x"), (0, 2, "y"), (0, 3, "z")], "g int, i int, c string")
    known = spark.createDataFrame([(0, "x", 7), (0, "x", 5)], "g int, c string, n int")
    near = spark.createDataFrame([(0, 1, 9), (0, 2, 8)], "g int, i int, n int")
    out = I.resolve_nodes(items, known, near, ["g"], "i", "c", "n")
    assert {r.i: r.n for r in out.collect()} == {1: 5, 2: 8, 3: None}


def test_strongest_and_verified_links(spark):
    links = spark.createDataFrame([(0, 1, 2.0, 9, True), (0, 1, 2.0, 4, True), (0, 1, 1.0, 3, False)], "g int, v int, w double, n int, face boolean")
    kept = G.strongest_equivalence(links, ["g", "v"], "w", "n", F.col("face"))
    assert sorted(r.n for r in kept.collect()) == [3, 4]


def test_bm25_matrix_and_join_agree(spark, monkeypatch):
    from cliptide.operators import lexical

    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, [words[int(j)] for j in rng.integers(0, 30, int(rng.integers(0, 15)))]) for i in range(80)], "d bigint, t array<string>")
    asked = spark.createDataFrame([(i, [words[int(j)] for j in rng.integers(0, 30, 4)]) for i in range(6)], "q bigint, t array<string>")
    run = lambda: {(r.q, r.d, r.rank, r.score) for r in lexical.bm25_top(docs, asked, "d", "q", "t", 5).collect()}
    by_matrix = run()
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 0)
    assert run() == by_matrix and by_matrix


def test_every_variant_is_emitted(spark):
    queries = spark.createDataFrame(
        [("g", 1, "<character_1> met <character_2>"), ("g", 2, "<character_1>, <character_1>"), ("g", 3, "<character_9>"), ("g", 4, "none")],
        "graph string, id bigint, question string",
    )
    members = [("g", f"character_{c}", f"voice_{c}{k:02d}") for c, n in ((1, 12), (2, 110)) for k in range(n)]
    out = identity.query_variants(
        queries, spark.createDataFrame(members + members[:3], "graph string, character_tag string, tag string"), ["graph"], ["id"], "question"
    ).collect()
    ones, twos = ([t for _, c, t in members if c == f"character_{k}"] for k in (1, 2))
    twos.sort()
    want = {(1, n, f"<{a}> met <{b}>") for n, (b, a) in enumerate((b, a) for b in twos for a in ones)}
    want |= {(2, n, f"<{a}>, <{a}>") for n, a in enumerate(ones)} | {(3, 0, "<character_9>"), (4, 0, "none")}
    assert len(out) == len(want) and {(r.id, r.variant, r.question) for r in out} == want


def test_cosine_histogram_counts_every_pair(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(2300, 8))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id bigint, v array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)[np.triu_indices(len(unit), 1)]
    bins, counts = np.unique(np.clip(np.floor((sims + 1) * 15), 0, 29).astype(int), return_counts=True)
    want = dict(zip(bins.tolist(), counts.tolist(), strict=True))
    assert {r.bin: r.n for r in metrics.cosine_histogram(frame, "id", "v").collect()} == want
    frame = frame.union(spark.createDataFrame([(None, [1.0] * 8), (9999, None)], frame.schema))
    monkeypatch.setattr(metrics, "PAIR_BLOCK", 500)
    assert {r.bin: r.n for r in metrics.cosine_histogram(frame, "id", "v").collect()} == want
