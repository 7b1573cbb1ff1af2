"""Phrase mining, spelling variants and the quadratic discriminant against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cliptide.llm import discriminant, phrases, spelling
from cliptide.llm.fmindex import Index, Words
from .conftest import FOLDER, LONG


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- 11: phrases ------------------------------------------------------------------------------------------------


def brute_phrases(rows, support, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f[lang].update(" ".join(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = set()
    for lang, count in f.items():
        kept = {p: a for p, a in count.items() if " " in p and a >= support}
        inner = set()
        for p, a in kept.items():
            w = p.split(" ")
            parts = {" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1)} - {p}
            inner |= {q for q in parts if 100 * a >= 100 * count[q]}
        rows = []
        for p in kept.keys() - inner:
            w, a = p.split(" "), kept[p]
            halves = [(count[" ".join(w[:k])], count[" ".join(w[k:])]) for k in range(1, len(w))]
            score, k = min((1000 * a * n[lang] // (x * y), k) for k, (x, y) in enumerate(halves))
            rows.append((-score, -a, p.encode(), *halves[k]))
        out |= {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])}
    return out


def rows_of(df):
    return {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize(("support", "top"), [(100, 2000), (12, 2000), (5, 40)])
def test_phrases(documents, support, top):
    want = brute_phrases([(r.lang, r.text) for r in documents.select("lang", "text").collect()], support, top)
    assert want and rows_of(phrases.collocations(documents, support, top)) == want


def test_phrases_are_the_same_however_the_rows_are_dealt(documents):
    one, many = (rows_of(phrases.collocations(documents.repartition(k), 12, 50)) for k in (1, 23))
    assert one == many


def test_phrases_with_odd_rows(odd, empty):
    rows = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    assert rows_of(phrases.collocations(odd, 2, 100)) == brute_phrases(rows, 2, 100)
    assert phrases.collocations(empty).collect() == []


def test_phrases_of_a_null_language(spark):
    rows = [(None, "a b. a b"), ("und", "A b"), ("x", None), ("x", ""), ("é", "b a, b a b a")]
    got = rows_of(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 2, 10))
    assert got == brute_phrases(rows, 2, 10) and {r[0] for r in got} == {"und", "é"}


def test_long_texts_are_cut_between_pieces():
    text = b"one two, three four. five\nsix seven eight " * 300
    for most in (10, 50, 1000, 1 << 20):
        parts = list(phrases.slices([text, b"", b"nine ten"], most))
        pieces = [p.split() for part in parts for p in re.split(rb"[.,;:!?\x0A-\x0D]", part) if p.split()]
        assert pieces == [p.split() for p in re.split(rb"[.,;:!?\x0A-\x0D]", text) if p.split()] + [[b"nine", b"ten"]]


def test_a_full_filter_changes_nothing(documents):
    """Phrases that stand in the filter by chance are counted and then fall to the threshold."""
    full = phrases.Filter(~phrases.Filter.empty().bits)
    texts = documents.select("lang", "text")
    some, every = ({tuple(r) for r in phrases.counted(texts, known, 12).collect()} for known in (phrases.candidates(texts, 12), full))
    assert some == every


@pytest.mark.parametrize("tasks", [3, 700])
def test_reports_of_many_tasks_are_added_up(spark, tasks):
    """Cell 7 has 5 above in three tasks, cell 9 one in each; the others can lack 85."""
    rows = [("en", 4, k, 0, phrases.packed(np.array([7, 9] if k < 3 else [9]), np.array([5, 1] if k < 3 else [1]))) for k in range(tasks)]
    rows.append(("en", -1, 0, 85, b""))
    known = phrases.passed(spark.createDataFrame(rows, phrases.REPORT), 100)
    digests = np.array([(4 << 16) + cell for cell in (7, 8, 9)], np.uint64)
    assert known.has(digests).tolist() == [True, False, tasks >= 15]
    assert int(np.unpackbits(known.bits).sum()) == 1 + (tasks >= 15)


# --- 12: spelling variants --------------------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_vocabulary(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}


def brute_groups(count):
    signs = defaultdict(set)
    for w in count:
        signs[w].add(w)
        for i in range(len(w)):
            signs[w[:i] + w[i + 1 :]].add(w)
            signs[w[:i] + "*" + w[i + 1 :]].add(w)
    beside = {w: set() for w in count}
    for some in signs.values():
        for a in some:
            beside[a] |= {b for b in some if near(a, b)}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        if best is not None and count[best] >= 2 * count[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(beside[w]), count.get(form.get(w))) for w, n in count.items()}


def groups_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_variants(documents):
    want = brute_groups(brute_vocabulary([(r.doc_id, r.text) for r in documents.collect()]))
    assert any(w[1] for w in want) and groups_of(spelling.group(documents)) == want


def test_spelling_with_odd_rows(odd, empty):
    assert groups_of(spelling.group(odd)) == brute_groups(brute_vocabulary([(r.doc_id, r.text) for r in odd.collect()]))
    assert spelling.group(empty).collect() == []


def test_runs_of_any_length(spark):
    rows = [(k, f"{'ab' * 9000} {'ab' * 9000}x wörter Wörter worter ×÷×÷× tie tie {'é' * 70}") for k in range(9)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert groups_of(spelling.group(table)) == brute_groups(brute_vocabulary(rows))


@pytest.mark.parametrize(("shard_words", "shard_queries"), [(7, 3), (50, 1000), (100000, 11)])
def test_shards_give_the_same(spark, documents, shard_words, shard_queries):
    count = brute_vocabulary([(r.doc_id, r.text) for r in documents.limit(40).collect()])
    words = spark.createDataFrame(sorted(count.items()), "word string, n bigint")
    got = {(r.word, r.n_near) for r in spelling.nearest(words, shard_words, shard_queries).collect()}
    assert got == {(w[0], w[4]) for w in brute_groups(count)}


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_index_finds_each_near_word_once(letters):
    rng = np.random.default_rng(5)

    def some(n, least):
        return sorted({"".join(rng.choice(list(letters), rng.integers(least, 9))) for _ in range(n)})

    for n in (1, 3, 80, 300):
        words, asked = some(n, 1), some(60, 2) + ["zz" + letters, letters + "z"]
        index, sizes = Index(words), np.array([len(q) for q in asked])
        asked_words = Words(asked, index.symbols)
        found = []
        rows, hits = index.near(asked, sizes // 2, True)
        found += zip(rows.tolist(), hits.tolist(), strict=True)
        rows, hits = index.near(asked, sizes - sizes // 2, False)
        new = ~index.same_start(asked_words, rows, hits, sizes // 2)
        found += zip(rows[new].tolist(), hits[new].tolist(), strict=True)
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for a, q in enumerate(asked) for b, w in enumerate(words) if near(q, w)}


def test_digests_of_document_and_word():
    ids, words = [b"", b"17", b"-9223372036854775808"], [b"a", "wört".encode(), b"x" * 63, b"y" * 64, b"z" * 5000]
    owner, number = (x.ravel() for x in np.meshgrid(range(3), range(5)))
    got = spelling.digests(ids, owner, words, number)
    assert got.tolist() == [zlib.crc32(ids[o] + b":" + words[k]) for o, k in zip(owner, number, strict=True)]


# --- 13: quality ------------------------------------------------------------------------------------------------


def density(x, mean, covariance):
    away = x - mean
    return -0.5 * (away @ np.linalg.inv(covariance) * away).sum(1) - 0.5 * np.linalg.slogdet(covariance)[1]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_discriminant_equals_dense_arithmetic(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    table = discriminant.described(documents)
    model = discriminant.train(table, labels)
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and not held_out(r.doc_id)}
    rows = [(r.doc_id, discriminant.statistics((r.text or "").encode())) for r in documents.collect()]
    x = {i: np.array(v) for i, v in rows if v is not None}
    parts = [np.array([x[i] for i, m in sorted(marks.items()) if m == label and i in x]) for label in (0, 1)]
    scale = np.concatenate(parts).std(0)
    parts = [p / scale for p in parts]
    own = [np.cov(p.T, bias=True) for p in parts]
    within = sum(len(p) * c for p, c in zip(parts, own, strict=True)) / sum(map(len, parts))
    prior = len(parts[1]) / sum(map(len, parts))
    everything = np.array(list(x.values()))

    def probability(pooled, ridge, temper):
        fits = []
        for p, c in zip(parts, own, strict=True):
            c = (1 - pooled) * c + pooled * within
            c = (1 - ridge) * c + (ridge * np.trace(c) / len(c) + 1e-9) * np.eye(len(c))
            fits.append(density(everything / scale, p.mean(0), c))
        return 1 / (1 + np.exp(-np.clip(temper * (fits[1] - fits[0]) + np.log(prior / (1 - prior)), -700, 700)))

    got = {r.doc_id: r.score for r in discriminant.scored(table, model).collect()}
    mine = np.array([got[i] for i in x])
    settings = [(p, r, t) for p in discriminant.POOLED for r in discriminant.ROUND for t in discriminant.TEMPER]
    assert min(np.abs(probability(*s) - mine).max() for s in settings) < 1e-6


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = discriminant.quality(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()
    marks = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(r.predicted, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    assert len(judged) > 50 and np.mean([a == b for a, b in judged]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in got)


def test_held_out_labels_and_other_columns_change_nothing(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality").collect()
    turned = [(r.doc_id, 1 - r.quality if held_out(r.doc_id) else r.quality) for r in labels]
    schema = "doc_id bigint, quality int"
    one = discriminant.quality(documents, spark.createDataFrame([tuple(r) for r in labels], schema))
    two = discriminant.quality(documents.drop("lang", "source"), spark.createDataFrame(turned, schema))
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}


def test_quality_with_odd_rows(spark, odd, empty, documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, 0), (6, None), (None, 1), (99, 1), (5, 1), (8, 7)], "doc_id bigint, quality int")
    for marks in (labels, labels.limit(0), labels.filter("quality = 1")):
        got = discriminant.quality(odd, marks).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (4, 7)}) == 1
        assert discriminant.quality(empty, marks).collect() == []
    model = discriminant.train(discriminant.described(documents), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = {r.doc_id: r.score for r in discriminant.scored(discriminant.described(odd), model).collect()}
    assert scores[1] == scores[2] == scores[3] == model.prior
    assert discriminant.statistics(LONG.encode()) is not None
