"""Characters where users have the numbers of face nodes."""

from __future__ import annotations

import datetime

from cliptide.catalog import graphs


def test_a_user_with_the_number_of_a_face_stays_apart(spark, tmp_path):
    # user 1007 has the number of face 7; users 3 and 5 are face 7, user 1007 is face 8, user 4 is nobody
    told = [(3, 7), (5, 7), (1007, 8), (4, 9)]
    at = datetime.datetime(2024, 1, 1)
    rows = [(n, at, u, "view" if u == 4 else "signup", 1.0, f'{{"k": {k}}}') for n, (u, k) in enumerate(told)]
    shape = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.node_id, r.type): r.character for r in graphs.characters(spark, str(tmp_path)).collect()}
    assert got == {
        (3, "voice"): 0, (5, "voice"): 0, (1007, "img"): 0, (4, "voice"): 1, (1007, "voice"): 2, (1008, "img"): 2, (1009, "img"): 3
    }
