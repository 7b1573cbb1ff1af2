import json

import pytest
from pyspark.sql import functions as F

from cliptide import config
from cliptide.functions import models as M
from cliptide.plans import records as P
from cliptide.sources import records as S


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n", encoding="utf-8")
    return str(path)


def candidate(clip, relevance, vector, **extra):
    return {"clip_id": clip, "relevance": relevance, "vector": vector, "text": f"t{clip}", **extra}


def test_select_keeps_other_fields_and_orders_by_time(spark, tmp_path):
    rows = [
        {
            "question": "q",
            "tag": {"a": 1},
            "candidates": [
                candidate("10", 0.9, [1.0, 0.0], start=30.0, end=60.0),
                candidate("2", 0.8, [0.0, 1.0], start=None),
                candidate("3", 0.1, [1.0, 1.0], start=0.0),
            ],
        }
    ]
    records = S.read_records(spark, write(tmp_path / "in.jsonl", rows))
    out = P.select_records(records, config.from_mapping({"max_k": 3})).first()
    assert out.selected_clip_ids == ["3", "10", "2"] or out.selected_k == 2
    assert out.selected_clip_ids[-1] == "2"  # null start last
    text = P.select_records(records, config.from_mapping({"max_k": 3})).select(F.to_json("passthrough")).first()[0]
    assert json.loads(text) == {"question": "q", "tag": {"a": 1}}


def test_nodes_need_structured_memory(spark, tmp_path):
    node = {"node_id": 1, "clip_id": 7, "relevance": 0.5, "embedding": [1.0, 0.0], "type": "episodic"}
    records = S.read_records(spark, write(tmp_path / "n.jsonl", [{"question": "q", "nodes": [node]}]))
    with pytest.raises(Exception, match="structured memory is off"):
        P.select_records(records, config.from_mapping({})).collect()
    on = config.from_mapping({"structured_memory": {"enabled": True}})
    assert P.select_records(records, on).first().selected_clip_ids == ["7"]


def test_broken_line_names_its_file(spark, tmp_path):
    path = tmp_path / "b.jsonl"
    path.write_text('{"question": "q"}\n[1, 2]\n', encoding="utf-8")
    with pytest.raises(Exception, match="b.jsonl"):
        S.read_records(spark, str(path)).collect()


def test_equal_records_stay_two_rows(spark, tmp_path):
    row = {"question": "q", "candidates": [candidate("1", 0.5, [1.0, 0.0])]}
    records = S.read_records(spark, write(tmp_path / "d.jsonl", [row, row]))
    out = P.select_records(records, config.from_mapping({})).collect()
    assert [r.selected_clip_ids for r in out] == [["1"], ["1"]]


def test_embed_answer_and_evaluate(spark, tmp_path):
    docs = [{"text": "red car stops"}, {"text": "blue bird sings"}]
    records = S.read_records(spark, write(tmp_path / "e.jsonl", [{"question": "where is the red car", "documents": docs}]))
    scored = P.embed_records(records, M.HashingEmbedder(32))
    best = scored.orderBy(F.desc("relevance")).first()
    assert (best.clip_id, best.text) == ("0", "red car stops")
    picked = P.select_records(records, config.from_mapping({"min_k": 1}), scored)
    answered = P.answer_records(picked, M.EchoChat(), F.lit("q"), F.array(F.lit("yes"), F.lit("no")))
    assert answered.first().prediction == "Answer:"
    rows = spark.createDataFrame(
        [("q", "(A) x", "A", 2), ("q", "unsure", "none", 3)], "question string, prediction string, ground_truth string, selected_k int"
    )
    _, metrics = P.evaluate_records(rows, "multiple_choice")
    row = metrics.first()
    assert (row.total, row.correct, row.mean_selected) == (2, 2, 2.5)  # two unreadable answers are equal


def test_config_errors():
    for bad in ({"min_k": 0}, {"min_k": 3, "max_k": 2}, {"start_k": 9}, {"lambda": 1.1}, {"candidate_pool": 0}, {"method": "x"}):
        with pytest.raises(ValueError):
            config.from_mapping(bad)
    with pytest.raises(TypeError):
        config.from_mapping({"nonsense": 1})
    assert config.from_mapping({"lambda": 0.5}).to_dict()["lambda"] == 0.5


def test_evidence_text(spark):
    item = "array<struct<clip_id string, text string, start double, end double>>"
    row = spark.sql(
        f"select cast(array(struct('1','a',1.0D,2.25D), struct('2','b',cast(null as double),cast(null as double))) as {item}) as e"
    )
    text = row.select(P.format_evidence(F.col("e"))).first()[0]
    assert text == "[Clip 1 | 1.0s-2.3s]\na\n\n[Clip 2]\nb" or text == "[Clip 1 | 1.0s-2.2s]\na\n\n[Clip 2]\nb"


def test_caption_memory(spark, tmp_path):
    memory = S.read_records(
        spark, write(tmp_path / "m.jsonl", [{"vid": "v", "clips": [{"caption": "c0", "asr": "s"}, {"description": "c1"}]}])
    )
    rows = S.caption_memory(memory).orderBy("seq").collect()
    assert [r.text for r in rows] == ["Visual description: c0\nTranscript: s", "Visual description: c1"]
