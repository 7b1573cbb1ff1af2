"""Arrays and maps of one large file, read in many splits, against a parse of the whole file."""

import json
import random

import pytest

from cliptide.sources import elements

NASTY = ['a"b', "c}d", "{", "}", "\\", "\\\\}", '"}', "x\ny", "é}ü{", "", '\\"', "[1, 2]", "k" * 300 + '"' * 3]


def records(n):
    rng = random.Random(4)
    return [
        {"id": k, "text": "".join(rng.choices(NASTY, k=3)), "in": {"list": [{"t": rng.choice(NASTY)} for _ in range(rng.randint(0, 3))]}, "x": k / 4}
        for k in range(n)
    ]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_array_in_many_splits(spark, tmp_path, small_splits, indent):
    rows = records(400)
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    assert elements._pieces(spark, str(path)).rdd.getNumPartitions() > 5
    got = elements.json_elements(spark, str(path)).collect()
    assert [json.loads(r.element) for r in sorted(got, key=lambda r: r.n)] == rows
    table = elements.json_table(spark, str(path))
    assert {(r.id, r.text, r.x, len(r["in"].list)) for r in table.collect()} == {(r["id"], r["text"], r["x"], len(r["in"]["list"])) for r in rows}


def test_map_in_many_splits(spark, tmp_path, small_splits):
    rows = {f'v"{k}}}': r for k, r in enumerate(records(200))}
    path = tmp_path / "map.json"
    path.write_text(json.dumps(rows, indent=1))
    got = sorted(elements.json_elements(spark, str(path), keyed=True).collect(), key=lambda r: r.n)
    assert [list(json.loads(r.element).items()) for r in got] == [[item] for item in rows.items()]


@pytest.mark.parametrize("text", ["", "[]", " [ ] \n", "[1, 2]"])
def test_files_without_objects(spark, tmp_path, text):
    path = tmp_path / "empty.json"
    path.write_text(text)
    assert elements.json_elements(spark, str(path)).collect() == []
    assert elements.json_elements(spark, str(path), keyed=True).collect() == []
    assert elements.json_table(spark, str(path)).collect() == []


def test_an_empty_map_has_no_members(spark, tmp_path):
    path = tmp_path / "empty.json"
    path.write_text("{}")
    assert elements.json_elements(spark, str(path), keyed=True).collect() == []
