"""Clips that arrive in any order give what the sorted table gives."""

import json
import time

import pytest

from cliptide.streaming import ordered, stateful

SCHEMA = "conv int, clip bigint, text string, last boolean"


def clips():
    texts = ["a b", "", "c", "bad clip", None, "dd", "e", "f g", "h"]
    return [(conv, n, texts[(n + conv) % len(texts)], n == 8) for conv in (1, 2, 3) for n in range(9)]


def refusing():
    """A scene fold that spoils its state and then fails on one text; a local class, so that workers get it by value."""

    class Refuse(ordered.SceneFold):
        def step(self, state, row):
            state["members"].append(-1)
            if row["text"] == "bad clip":
                raise RuntimeError(f"clip {row['clip']} is bad")
            state["members"].pop()
            return super().step(state, row)

    return Refuse("text", "clip", "last", 3)


def write_files(spark, folder, rows):
    """One file per row, the oldest first in the given order."""
    folder.mkdir(exist_ok=True)
    for n, row in enumerate(rows):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.json(str(folder / f"part{n:02d}"))
        time.sleep(0.01)


def stream(spark, folder):
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).option("recursiveFileLookup", "true")
    return reader.json(str(folder))


def plain(df):
    return sorted((r.conv, r.clip, r.status, r.error, r.made) for r in df.collect())


def test_reversed_files_equal_the_sorted_table(spark, tmp_path):
    rows = clips()
    write_files(spark, tmp_path, rows[::-1])
    fold = refusing()
    done = stateful.run_available(ordered.in_order(stream(spark, tmp_path), "conv", "clip", ["text", "last"], fold), spark, "reversed")
    want = ordered.fold_table(spark, spark.createDataFrame(rows, SCHEMA), "conv", "clip", ["text", "last"], fold)
    assert plain(done) == plain(want)
    failed = ordered.failures(done).collect()
    assert sorted((r.conv, r.clip, r.error) for r in failed) == [(c, n, f"RuntimeError: clip {n} is bad") for c, n in ((1, 2), (2, 1), (3, 0))]
    scenes = ordered.results(done, "conv", "scene bigint, last_clip bigint, clips bigint, members array<bigint>, fragments bigint")
    assert {(r.conv, tuple(r.members)) for r in scenes.collect() if r.conv == 1} == {(1, (0, 1, 3)), (1, (4, 5, 6)), (1, (7, 8))}


def test_gaps_are_given_up_and_repeats_reported(spark, tmp_path):
    rows = [(1, n, "text", False) for n in (4, 2, 0, 2, None)]
    clips_at, progress = tmp_path / "clips", tmp_path / "progress"
    write_files(spark, clips_at, rows)
    query = (
        ordered.in_order(stream(spark, clips_at), "conv", "clip", ["text", "last"], ordered.SceneFold("text", "clip", "last", 2), patience_ms=500)
        .writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(progress)).start()
    )
    want = [(-1, "failed"), (0, "done"), (1, "missing"), (2, "done"), (2, "repeated"), (3, "missing"), (4, "done")]
    got = []
    for _ in range(120):
        got = sorted((-1 if r.clip is None else r.clip, r.status) for r in spark.table("gaps").collect())
        if len(got) >= len(want):
            break
        time.sleep(0.5)
    query.stop()
    assert got == want


def test_folds_keep_their_state_in_json():
    fold = ordered.SceneFold("text", "clip", "last", 2)
    state, made = fold.begin(), []
    for n in range(5):
        state, some = fold.step(json.loads(json.dumps(state)), {"clip": n, "text": "x" if n else " ", "last": n == 4})
        made += some
    assert [(m["members"], m["fragments"]) for m in made] == [([0, 1], 1), ([2, 3], 2), ([4], 1)]
    with pytest.raises(ValueError, match="length 7"):
        ordered.LengthFold("text", 7).step(0, {"text": "seven77"})
