"""Streams over the tables, written as one file or as a folder of files."""

from __future__ import annotations

import shutil

import pytest

from cliptide.catalog import streams


@pytest.mark.parametrize("files", [0, 3])
def test_streams_read_files_and_folders(spark, tmp_path, files):
    turns = [(c, t, "a" * (c + 2 * t)) for c in range(4) for t in range(5)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    path = f"{tmp_path}/conversations.parquet"
    rows.repartition(files or 1).write.parquet(path if files else f"{tmp_path}/made")
    if not files:
        shutil.copy(next((tmp_path / "made").glob("*.parquet")), path)
    # another table beside it is not read
    rows.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    clips = streams.ordered_clips(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.turn, r.status == "failed") for r in clips) == [(c, t, len(x) % 7 == 0) for c, t, x in turns]
    scenes = streams.stream_scene_windows(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.last_turn, r.clips) for r in scenes) == [(c, 4, 5) for c in range(4)]
