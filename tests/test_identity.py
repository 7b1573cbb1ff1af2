"""Queries that ask for the same characters share one answer."""

from __future__ import annotations

from cliptide.operators import identity


def test_speakers_stand_once_per_set_of_names(spark):
    names = spark.createDataFrame([(0, 1, "Mary Ann"), (0, 2, "Tom"), (0, 3, "tom"), (1, 4, "Tom")], "g int, voice long, name string")
    texts = ["Did Tom go?", "Tom, mary ann!", "Who is TOM?", "mary left", "Mary Ann saw Tom"]
    asked = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)] + [(1, 9, "Tom")], "g int, id int, text string")
    members, speakers = identity.asked_speakers(asked, names, ["g"], "text", ["id"])
    assert members.columns == ["g", "id", "names"] and speakers.columns == ["g", "names", "voice"]
    # three sets of names with two, three and one voices; the queries ask for eleven
    assert speakers.count() == 6
    found = members.join(speakers, ["g", "names"]).groupBy("g", "id").agg({"voice": "collect_list"}).collect()
    assert {(g, i): sorted(v) for g, i, v in found} == {
        (0, 0): [2, 3], (0, 1): [1, 2, 3], (0, 2): [2, 3], (0, 4): [1, 2, 3], (1, 9): [4]
    }


def test_related_nodes_stand_once_per_set_of_tags(spark):
    rows = [(0, "character_1", "voice_1"), (0, "character_1", "face_7"), (0, "character_2", "voice_2")]
    members = spark.createDataFrame(rows, "g int, character_tag string, tag string")
    texts = ["<character_1> and <face_7>", "<face_7>, <character_1>?", "<voice_2>", "<character_9>", "<character_2><voice_2>"]
    asked = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "g int, id int, text string")
    sets, nodes = identity.related_nodes(asked, members, ["g"], ["id"], "text")
    # {character_1, face_7}, {voice_2} and {character_2, voice_2}
    assert nodes.count() == 4
    found = sets.join(nodes, ["g", "asked"]).groupBy("id").agg({"tag": "collect_list"}).collect()
    assert {i: sorted(t) for i, t in found} == {0: ["face_7", "voice_1"], 1: ["face_7", "voice_1"], 2: ["voice_2"], 4: ["voice_2"]}


def test_ends_of_variants_without_forming_them(spark):
    queries = [
        (0, 1, "<character_1> met <character_2>, <character_1>"), (0, 2, "<character_2>"), (0, 3, "<character_9> none"), (0, 4, None),
        (0, 5, "<character_2> <character_3>"),
    ]
    asked = spark.createDataFrame(queries, "g int, id int, text string")
    rows = [(0, f"character_{c}", f"voice_{k}") for c, ks in ((1, (1, 10, 2)), (2, (20, 2, 200, 3))) for k in ks]
    members = spark.createDataFrame(rows + rows[:2], "g int, character_tag string, tag string")
    every = identity.query_variants(asked, members, ["g"], ["id"], "text").collect()
    want = {}
    for r in every:
        want.setdefault(r.id, []).append(r.text)
    got = {r.id: (r.variants, r.first, r.last) for r in identity.variant_ends(asked, members, ["g"], ["id"], "text").collect()}
    assert got == {i: (len(t), None, None) if t[0] is None else (len(t), min(t), max(t)) for i, t in want.items()}
    # four times 400,000 variants, none formed
    many = members.unionByName(spark.range(400000).selectExpr("0 g", "'character_3' character_tag", "concat('face_', id) tag"))
    last = identity.variant_ends(asked, many, ["g"], ["id"], "text").filter("id = 5").first()
    assert (last.variants, last.first, last.last) == (1600000, "<voice_200> <face_0>", "<voice_3> <face_9>")
