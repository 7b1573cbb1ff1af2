"""Resembling names against the standard library's matching blocks, and hints against all pairs."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from cliptide.functions import names as N
from cliptide.operators import hints


def words(n, seed, letters="abcde"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def plain_score(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if (len(a) >= 3 and a in b) or (len(b) >= 3 and b in a):
        return 0.95
    ratio = SequenceMatcher(None, a, b).ratio()
    return ratio if a[:2] == b[:2] and len(a) > 1 and len(b) > 1 and ratio >= 0.45 else 0.0


def test_block_ratio(spark):
    pairs = [*zip(words(300, 1), words(300, 2), strict=True), *zip(words(60, 3, "ab"), words(60, 4, "ab"), strict=True), ("a", ""), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", N.block_ratio(F.col("a"), F.col("b")).alias("ratio")).collect():
        assert abs(r.ratio - SequenceMatcher(None, r.a, r.b).ratio()) < 1e-12, (r.a, r.b)


def test_name_similarity(spark):
    pairs = [("Alice", "alice "), ("Ali", "Alice"), ("Bob", "Alice"), ("Alicia", "Alise"), ("", "x"), (None, "x"), ("J", "j"), ("Al", "Ali")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [round(r[0], 3) for r in df.select(N.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.95, 0.0, round(SequenceMatcher(None, "alicia", "alise").ratio(), 3), 0.0, 0.0, 1.0, 0.8]


def test_identity_hints(spark):
    told = [(g, v, name.title()) for g in (1, 2) for v, name in enumerate(words(60, 5 + g, "abc"))]
    named = hints.character_names(
        spark.createDataFrame(told, "g int, voice bigint, name string"),
        spark.createDataFrame([(g, v, v % 20) for g, v, _ in told], "g int, node_id bigint, character bigint"),
        ["g"],
    )
    asked = [(1, k, w) for k, w in enumerate(words(25, 9, "abc"))] + [(2, 99, "  ABc! "), (2, 100, ""), (2, 101, None)]
    got = hints.identity_hints(spark.createDataFrame(asked, "g int, q int, name string"), named, ["g"], ["q"], "name").collect()
    want = set()
    for g, q, name in asked:
        name = "abc" if q == 99 else name or ""
        found = {(-plain_score(name, n.lower()), v % 20, n.lower()) for h, v, n in told if h == g and plain_score(name, n.lower()) > 0}
        want |= {(g, q, c, n, round(-s, 9), at + 1) for at, (s, c, n) in enumerate(sorted(found))}
    assert want and {(r.g, r.q, r.character, r.candidate, round(r.score, 9), r["rank"]) for r in got} == want
    some = hints.names_of_character(spark.createDataFrame([(1, 7, 3)], "g int, q int, character bigint"), named, ["g"], ["q"]).collect()
    assert {r.spelled for r in some} == {n for g, v, n in told if g == 1 and v % 20 == 3}
