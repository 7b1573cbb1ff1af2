"""Selections that read the whole ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliptide.operators import coverage, lexical, ranking


def test_largest_fall_may_come_after_many_clips(spark):
    # label 0 falls most after clip 249 of 300, label 1 after its second clip, label 2 has one clip
    rows = [(0, k, k, 0.9 - k / 1000 - (0.2 if k > 249 else 0.0)) for k in range(300)]
    rows += [(1, k, 2 * k + 1, 0.9 - k / 1000 - (0.2 if k > 1 else 0.0)) for k in range(20)] + [(1, 3, 5000, 0.1), (2, 7, 7, 0.5)]
    nodes = spark.createDataFrame(rows, "label int, clip_id int, vec_id int, score double")
    got = ranking.clips_from_clip_curve(nodes, ["label"], "score", "vec_id").collect()
    want = {(0, k, k + 1) for k in range(8)} | {(1, k, k + 1) for k in range(4)} | {(2, 7, 1)}
    assert len(got) == len(want) and {(r.label, r.clip_id, r.rank) for r in got} == want


def test_words_of_a_text_are_looked_up_once(spark):
    texts = [(1, "Cooking and cooked, COOKING cooks; walk <face_3> <face_3> the tables"), (2, None), (3, "the and")]
    rows = spark.createDataFrame(texts, "id int, text string").select("id", coverage.evidence_tokens(F.col("text")).alias("t"))
    got = {r.id: (r.t.entities, r.t.words, r.t.actions) for r in rows.collect()}
    assert got[1] == (["<face_3>"], ["cook", "walk", "face_3", "tabl"], ["cook", "walk"]) and got[2] == got[3] == ([], [], [])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2


def test_bm25_scores_a_few_documents_at_once(spark, monkeypatch):
    docs = spark.range(60).selectExpr("id doc", "transform(sequence(1, 3 + id % 5), i -> concat('w', (id * i) % 7)) tokens").coalesce(1)
    asked = spark.createDataFrame([(0, ["w1", "w2"]), (1, ["w3", "w3", "w5"])], "item int, tokens array<string>")
    best = lambda: sorted(map(tuple, lexical.bm25_top(docs, asked, "doc", "item", "tokens", 10).collect()))
    whole = best()
    monkeypatch.setattr(lexical, "SCORED_ROWS", 7)
    assert len(whole) == 20 and best() == whole
