import json

import pytest
from pyspark.sql import functions as F

from cliptide.sources import captions as C
from cliptide.sources import datasets as D
from cliptide.sources import lines as L
from cliptide.sources import subtitles as S
from cliptide.sources import tables as T

SRT = "1\n00:00:01,500 --> 00:00:04,000\n<i>hello</i> there\n\n2\n00:00:05,000 --> 00:00:06,000\nbye\n\n3\n00:01:00,000 --> 00:01:10,000\nend\n"


@pytest.fixture
def srt(spark, tmp_path):
    (tmp_path / "v1.srt").write_text(SRT, encoding="utf-8")
    (tmp_path / "v2.srt").write_text("plain text\n12\nmore\n", encoding="utf-8")
    return L.read_files(spark, str(tmp_path), ".srt")


def text_of(df):
    return {r.name: r.text for r in L.as_text(df, ["name"]).collect()}


def test_srt_lines_with_and_without_time(srt):
    assert text_of(S.srt_lines(srt, ["name"]))["v1"].split("\n")[:3] == ["1", "00:00:01,500 --> 00:00:04,000", "hello there"]
    assert text_of(S.srt_lines(srt, ["name"], include_time=False))["v1"] == "hello there\nbye\nend"
    # stride 2: blocks 1 and 3, then every second remaining line
    kept = text_of(S.srt_lines(srt, ["name"], stride=2))["v1"].split("\n")
    assert kept == ["1", "hello there", "3", "end"]


def test_timed_blocks(srt):
    rows = {(r.name, r["index"]): r for r in S.timed_blocks(srt, ["name"]).collect()}
    assert rows[("v1", 0)].text == "hello there".replace("hello", "<i>hello</i>")
    assert rows[("v1", 2)].start == 60.0 and rows[("v1", 2)].time_label == "00:01:00 --> 00:01:10"
    assert rows[("v2", 0)].text == "plain text\nmore" and rows[("v2", 0)].start is None


def test_whole_seconds(srt):
    rows = [(r.start, r.end, r.text) for r in S.whole_second_cues(srt, ["name"]).orderBy("pos").collect()]
    assert rows[0] == (1, 4, "<i>hello</i> there") and rows[2] == (60, 70, "end")


def test_json_cues(spark):
    two = spark.createDataFrame(
        [("v", 0, "1", "2", "a", None, None), ("v", 1, None, None, None, ["3", "4"], "b")],
        "name string, pos int, start string, end string, line string, timestamp array<string>, text string",
    )
    rows = [r.line for r in S.json_cue_text(two, ["name"], "pos").orderBy("pos").collect()]
    assert rows == ["1 --> 2\na\n", "3 --> 4\nb\n"]


def test_caption_blocks_and_fallback(spark):
    files = spark.createDataFrame([("v", "a\nb\nc\n")], "name string, text string")
    rows = [(r["index"], r.time_label, r.text) for r in C.caption_blocks(files, ["name"], 2, 30).orderBy("index").collect()]
    assert rows == [(0, "00:00:00 --> 00:00:30", "a"), (1, "00:01:00 --> 00:01:30", "c")]
    wanted = spark.createDataFrame([("v",), ("w",)], "id string")
    found = C.first_existing(wanted, files, "id", [F.concat(F.lit("x"), "id"), F.col("id")])
    assert {r.id: r.text for r in found.collect()} == {"v": "a\nb\nc\n", "w": ""}


def test_memory_documents_join_overlapping_cues(spark):
    schema = "v string, index bigint, start double, end double, time_label string, text string"
    caps = spark.createDataFrame([("a", 0, 0.0, 30.0, "", "c0"), ("a", 1, 30.0, 60.0, "", "c1")], schema)
    subs = spark.createDataFrame(
        [("a", 0, 10.0, 20.0, "", "s0"), ("a", 1, 25.0, 35.0, "", "s1"), ("a", 2, 60.0, 61.0, "", "s2"), ("b", 0, 0.0, 1.0, "", "t")],
        schema,
    )
    docs = {(r.v, r.doc_id): r for r in C.memory_documents(caps, subs, ["v"]).collect()}
    assert docs[("a", "caption:0")].subtitle.count("-->") == 2
    assert docs[("a", "caption:1")].text == "Caption:\nc1\n\nSubtitle:\n00:00:25 --> 00:00:35\ns1"
    assert docs[("b", "subtitle:0")].text == "Subtitle:\nt"
    assert len(docs) == 3


def test_look_back_spills_into_previous_hour(spark):
    cues = spark.createDataFrame(
        [("d", 11, 0, 11595000, 11595500, "late"), ("d", 11, 3, 11500000, 11500500, "early"), ("d", 12, 0, 12005000, 12005500, "now")],
        "date string, hour bigint, pos int, start bigint, end bigint, text string",
    )
    queries = spark.createDataFrame([("q1", "d", "12010000"), ("q2", "d", "12300000")], "q string, date string, at string")
    out = S.look_back_cues(queries, cues, ["date"], "hour", "at", 300_000)
    got = {}
    for r in out.collect():
        got.setdefault(r.q, set()).add(r.text)
    # q1 reaches back 290000 packed units into the hour before, that is to 11310000
    assert got == {"q1": {"now", "late", "early"}, "q2": {"now"}}


def test_look_back_captions_drop_the_last(spark):
    files = spark.createDataFrame([("d", 12005000, "a"), ("d", 12010000, "b"), ("d", 12020000, "c")], "date string, stamp bigint, text string")
    queries = spark.createDataFrame([("q", "d", "12015000")], "q string, date string, at string")
    rows = C.look_back_captions(queries, files, ["date"], "q", "at", "stamp").collect()
    assert [(r.text, r.time_label) for r in rows] == [("a", "12:00:50.00 --> 12:01:00.00")]


def test_keyed_json_captions(spark, tmp_path):
    folder = tmp_path / "vid"
    folder.mkdir()
    for n in (10, 2):
        (folder / f"{n}.json").write_text("```json\n" + json.dumps({"Summary": f"s{n}", "Scene Context": "x"}) + "\n```\n")
    rows = C.keyed_json_captions(spark, str(tmp_path), ["Scene Context", "Summary"]).orderBy("index").collect()
    assert [r.text for r in rows] == ["Scene Context.\nx\nSummary.\ns2", "Scene Context.\nx\nSummary.\ns10"]


def test_dataset_items(spark):
    anno = spark.createDataFrame(
        [(1, "a.mp4", "q?", ["x", "y"], "3.5", "count", "x")],
        "ord bigint, video_name string, question string, candidates array<string>, duration string, task_type string, answer string",
    )
    subs = spark.createDataFrame([("a", "sub")], "video_id string, text string")
    row = D.items(anno, "MLVU", "ord", subs).first()
    assert (row.global_idx, row.video_id, row.duration, row.subtitle, row.caption) == (0, "a", 3.5, "sub", "")
    with pytest.raises(NotImplementedError):
        D.items(anno, "nothing", "ord")


def test_nested_questions(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"v1": {"qa_list": [{"question_id": "1", "question": "a", "answer": "b", "type": ["t"]}, {"question_id": "2", "question": "c"}], "caption": "cap"}}))
    rows = D.items(D.nested_questions(spark, str(path)), "m3bench", "ordinal").orderBy("global_idx").collect()
    assert [(r.global_idx, r.question_id, r.caption, r.task_type) for r in rows] == [(0, "1", "cap", ["t"]), (1, "2", "cap", [])]


def test_id_list_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([("1",), ("2",)], "id string")
    (tmp_path / "ids.txt").write_text("# c\n2\n9\n")
    kept, missing = D.known_ids(rows, spark.read.text(str(tmp_path / "ids.txt")), "id")
    assert [r.id for r in kept.collect()] == ["2"] and [r.id for r in missing.collect()] == ["9"]
    (tmp_path / "t.csv").write_text("ID,x\na,1\na,2\n")
    with pytest.raises(Exception, match="duplicate ID"):
        T.read_csv(spark, str(tmp_path / "t.csv")).collect()
    (tmp_path / "wav.scp").write_text("u1 /a/b c.wav\nu2 /d.wav\n")
    assert {r.key: r.value for r in T.read_pairs(spark, str(tmp_path / "wav.scp")).collect()}["u1"] == "/a/b c.wav"
    segs = spark.createDataFrame([("r", 1.0, 2.5, 0)], "rec string, start double, end double, speaker int")
    assert T.rttm_lines(segs, "rec").first().value == "SPEAKER r 0 1.000 1.500 <NA> <NA> 0 <NA> <NA>"


def test_run_logs(spark, tmp_path):
    (tmp_path / "3.json").write_text(json.dumps({"response": "A", "answer": "A", "retrieval_trace": {"selector": "s", "selector_trace": {"selected_count": 4}}}))
    (tmp_path / "notes.json").write_text("{}")
    rows = T.read_run(spark, str(tmp_path)).collect()
    assert [(r.global_idx, r.selector, r.k) for r in rows] == [(3, "s", 4)]


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("g", 1), ("h", 2)], "graph string, node_id int")
    edges = spark.createDataFrame([("g", 1, 1)], "graph string, src int, dst int")
    T.write_graph(nodes, edges, str(tmp_path / "g"), "graph")
    n, e = T.read_graph(spark, str(tmp_path / "g"))
    assert n.filter("graph = 'g'").count() == 1 and e.count() == 1


def test_submission_counts(spark):
    ref = spark.createDataFrame([("v", 1), ("v", 2), ("w", 1)], "video_uid string, qid int")
    pred = spark.createDataFrame([("v", 1, "B"), ("v", 2, "Z")], "video_uid string, qid int, predicted_answer_label string")
    _, counts = T.fill_predictions(ref, pred, ["video_uid", "qid"])
    assert tuple(counts.first()) == (3, 2, 1, 1)


def test_usage_and_clips(spark):
    calls = spark.createDataFrame([("m", 1_000_000, 500_000), ("x", 1, 1)], "model string, input_tokens bigint, output_tokens bigint")
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, input_price double, output_price double")
    assert {r.model: r.cost_usd for r in T.usage_rows(calls, prices).collect()} == {"m": 4.0, "x": 0.0}
    clips = spark.createDataFrame([("10", 5.0, 100), ("2", 5.0, 100), ("a", 5.0, 100), ("3", 1.0, 100)], "name string, s double, f int")
    assert [r.name for r in T.clip_listing(clips, "name", "s", "f").orderBy("sort_key").collect()] == ["2", "10", "a"]
