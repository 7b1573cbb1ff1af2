"""Every stage of the pipeline against brute force, each on what the stage before kept."""

import hashlib
import math
from collections import defaultdict

import pytest

import corpus_pipeline
from cliptide.llm import toxicity
from cliptide.llm.common import table, written

from .conftest import FOLDER
from .test_operators import brute_components, brute_hits


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"], r["text"]))


def toxic_free(spark, docs, rows):
    model = toxicity.train(docs, table(spark, FOLDER, "labels"))
    scorer = toxicity.Scorer(model.toxic, model.plain)
    return [r for r in rows if toxicity.probability(model, scorer, (r["text"] or "").encode()) < 0.5]


def fresh_lines(spark, docs, rows):
    seen, out = set(), []
    for r in rows:
        lines = r["text"].split("\n")
        filled = [k for k, line in enumerate(lines) if line.strip(" ")]
        gone = set()
        for a, b in zip(filled, filled[1:], strict=False):
            if (lines[a], lines[b]) in seen:
                gone |= set(range(a, b + 1))
            seen.add((lines[a], lines[b]))
        if gone:
            text = "\n".join(line for k, line in enumerate(lines) if k not in gone)
            if text.strip(" "):
                out.append(r | {"text": text, "n_chars": len(text)})
        else:
            out.append(r)
    return out


def first_of_groups(spark, docs, rows):
    groups = brute_components([(r["doc_id"], r["text"]) for r in rows])
    return [r for r in rows if groups[r["doc_id"]][0] == 0 or groups[r["doc_id"]][1] == r["doc_id"]]


def without_items(spark, docs, rows):
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    hit = {i for i, _ in brute_hits([(r["doc_id"], r["text"]) for r in rows], items)}
    return [r for r in rows if r["doc_id"] not in hit]


def mixed(spark, docs, rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append((len(r["text"].encode().split()), r))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sources))}
    size = {s: sum(n for n, _ in group) for s, group in sources.items()}
    left, full = 1.5 * sum(size.values()), {}
    while True:
        level = left / sum(w for s, w in weight.items() if s not in full)
        more = {s: 2 * size[s] for s in sources if s not in full and 2 * size[s] <= level * weight[s]}
        if not more:
            break
        full |= more
        left -= sum(more.values())
    out = []
    for s, group in sources.items():
        rate = (full[s] if s in full else level * weight[s]) / size[s]
        offset = int(hashlib.md5(s.encode()).hexdigest()[:8], 16) / 2**32
        for k, (_, r) in enumerate(sorted(group, key=lambda x: (-x[0], x[1]["doc_id"]))):
            copies = math.floor(rate * (k + 1) + offset) - math.floor(rate * k + offset)
            out += [r | {"copy": c + 1} for c in range(copies)]
    return out


BRUTE = [toxic_free, fresh_lines, first_of_groups, without_items, mixed]


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    for (name, stage), brute in zip(corpus_pipeline.STAGES, BRUTE, strict=True):
        want = brute(spark, docs, rows_of(docs))
        docs = written(stage(spark, docs, FOLDER))
        key = lambda r: (r["doc_id"], r["text"], r.get("copy", 0))
        assert sorted(rows_of(docs), key=key) == sorted(want, key=key), name
        assert docs.columns == columns or stage is corpus_pipeline.STAGES[-1][1]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[1:]])
def test_stages_with_odd_rows(spark, odd, empty, stage):
    assert stage(spark, odd, FOLDER).columns[: len(odd.columns)] == odd.columns
    assert 0 < stage(spark, odd, FOLDER).count() <= 2 * odd.count()
    assert stage(spark, empty, FOLDER).count() == 0


def test_mix_beside_columns_named_copy(spark, odd):
    got = corpus_pipeline.mix_sources(spark, odd.selectExpr("*", "'x' AS Copy"), FOLDER)
    assert got.columns[-2:] == ["Copy", "copy__"]
    assert {r.Copy for r in written(got).select("Copy").collect()} == {"x"}
    assert corpus_pipeline.mix_sources(spark, odd, FOLDER).columns[-1] == "copy"
