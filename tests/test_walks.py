"""Walks over texts that share entities."""

import contextlib
import io

from cliptide.operators import walks


def test_walks_of_one_graph_are_not_dealt_by_the_graph(spark, monkeypatch):
    plans = []

    def seen(df):
        with contextlib.redirect_stdout(io.StringIO()) as shown:
            df.explain()
        plans.append(shown.getvalue())
        return cut(df)

    cut = walks.cut_lineage
    monkeypatch.setattr(walks, "cut_lineage", seen)
    edges = spark.createDataFrame([(0, t, t % 3) for t in range(12)], "graph int, text bigint, entity bigint")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = walks.route_walks(edges, ["graph"], edges.select("graph", "text").withColumnRenamed("text", "walk"), 1).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(found) == 12 and all(len(r.route) == 1 for r in found)
    assert "BroadcastHashJoin" in plans[-1]
