"""Operators against brute force on small tables, and on rows that are easy to get wrong."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cliptide.llm import common, decontaminate, jaccard, licenses, linedup, longrepeats, mixing, pivots, ppm, rlindex, toxicity, unitdedup
from .conftest import FOLDER, LONG, ROWS


def held_out(doc_id, parts, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == rest


def texts(documents):
    return [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]


# --- 1: benchmark decontamination -------------------------------------------------------------------------------


def brute_hits(rows, items):
    found = set()
    for doc_id, text in rows:
        words = decontaminate.words_of((text or "").encode())
        grams = {n: decontaminate.runs(words, n) for n in range(1, 6)}
        for item, body in items:
            parts = [decontaminate.shingles(p) for p in decontaminate.question_and_answer((body or "").encode())]
            if decontaminate.words_of((body or "").encode()) and all(not g or len(g & grams[n]) >= 0.8 * len(g) for n, g in parts):
                found.add((doc_id, item))
    return found


def test_benchmark_items_are_found(spark, documents):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents, items).collect()}
    assert got == brute_hits(texts(documents), [(r.item_id, r.text) for r in items.collect()])


def test_items_in_shares_give_the_same(spark, documents, monkeypatch):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents, items).collect()}
    shares = list(decontaminate.item_shards(items, 4000))
    assert len(shares) > 1 and sum(map(len, shares)) == items.count()
    parts = set()
    for share in shares:
        part = spark.createDataFrame([(i, t.decode()) for i, t in share], "item_id bigint, text string")
        parts |= {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents, part).collect()}
    assert parts == whole  # weights differ between shares, the overlap decides


@pytest.mark.parametrize("others", [[], [31], [16], [29, 63]])
def test_items_are_found_at_every_offset(others):
    asked, told = [b"q%d" % k for k in range(20)], [b"a%d" % k for k in range(10)]
    item = b" ".join(asked) + b". " + b" ".join(told)
    items = [(1, item), *((10 + n, b" ".join(b"o%d_%d" % (n, k) for k in range(n))) for n in others)]
    searcher = decontaminate.Searcher(items)
    texts = [
        b" ".join([*(b"f%d" % k for k in range(before)), *asked, *(b"x%d" % k for k in range(filler)), *told, *(b"g%d" % k for k in range(after))])
        for filler in (0, 12, 34)
        for after in (0, 5, 200)
        for before in range(140)
    ]
    for text, got in zip(texts, searcher.search(texts), strict=True):
        assert [x[0] for x in got] == [1]
        _, first, end, score, *shares = got[0]
        words = decontaminate.words_of(text)[first:end]
        assert {*asked, *told} <= set(words) or min(score, *shares) < 1
        assert decontaminate.held(decontaminate.shingles(asked), words) == shares[0] and decontaminate.held(decontaminate.shingles(told), words) == shares[1]
    apart = [b" ".join([*(b"f%d" % k for k in range(before)), *asked, *(b"x%d" % k for k in range(60)), *told]) for before in range(140)]
    assert searcher.search(apart) == [[]] * len(apart)  # farther apart than a passage, from any word on


def test_items_with_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (None, "x")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items).collect()] == [(None, 3)]
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0
    assert decontaminate.leaks(empty, items).count() == 0
    assert decontaminate.keep_clean(odd, items).count() == len(ROWS) - 1
    assert decontaminate.keep_clean(odd, items).columns == odd.columns


# --- 2: PPM -----------------------------------------------------------------------------------------------------


def plain_ppm(rows, order=ppm.ORDER):
    seen = defaultdict(Counter)
    for doc_id, text in rows:
        if not held_out(doc_id, 7, 2):
            s = b"\n" * order + b" ".join((text or "").encode().lower().split()) + b"\n"
            for p in range(order, len(s)):
                for k in range(order + 1):
                    seen[s[p - k : p]][s[p]] += 1

    def log10(context, symbol):
        gone, total = set(), 0.0
        for k in range(order, -1, -1):
            counts = seen.get(context[order - k :])
            if not counts:
                continue
            left = {x: n for x, n in counts.items() if x not in gone}
            if left:
                if symbol in left:
                    return total + math.log10((left[symbol] - 0.5) / sum(left.values()))
                total += math.log10(0.5 * len(left) / sum(left.values()))
            gone |= set(counts)
        return total - math.log10(max(256 - len(gone), 1))

    def score(text):
        s = b"\n" * order + b" ".join((text or "").encode().lower().split()) + b"\n"
        return sum(log10(s[p - order : p], s[p]) for p in range(order, len(s)))

    return score


@pytest.mark.parametrize("shard", [10**9, 3000])
def test_ppm_and_base(documents, monkeypatch, shard):
    monkeypatch.setattr(ppm.shards, "__defaults__", (shard,))
    monkeypatch.setattr(ppm, "HOT_WORDS", 500)
    rows = texts(documents)
    counts = Counter(w for i, t in rows if not held_out(i, 7, 2) for w in t.encode().lower().split())
    ends = sum(not held_out(i, 7, 2) for i, _ in rows)
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    score = plain_ppm(rows)
    by_id = dict(rows)
    got = ppm.score(documents).collect()
    assert sorted(r.doc_id for r in got) == sorted(by_id)
    for r in got:
        words = by_id[r.doc_id].encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words) + math.log10((ends + 1) / (total + kinds + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id, 7, 2), len(words) + 1, sum(w in counts for w in words) + 1, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    for r in got[:20]:
        assert r.score == pytest.approx(score(by_id[r.doc_id]), rel=1e-5)


def test_ppm_gives_probabilities():
    layout = ppm.Layout([b"the cat sat on the mat", b"the dog"])
    grams, counts = np.unique(layout.grams(), return_counts=True)
    low = np.zeros((256, 256), np.int64)
    np.add.at(low, (((grams >> np.uint64(8)) & np.uint64(255)).astype(int), (grams & np.uint64(255)).astype(int)), counts)
    trie = ppm.Trie(grams, counts, low)
    for context in (b"\n\n\n\n\n", b"e cat", b"xxthe", b"qqqqq"):
        head = int.from_bytes(context, "big") << 8
        logs = trie.log10(np.array([head | s for s in range(256)], np.uint64))
        assert (10.0**logs).sum() == pytest.approx(1, abs=1e-4)


def test_ppm_worker_memory():
    """What a task holds of the largest part of a model and of a batch stays under 400 MB: two of them share 3,000 MB with a heap of 1,800."""
    draw = np.random.default_rng(2)
    words = [bytes(draw.integers(97, 123, draw.integers(2, 10), dtype=np.uint8)) for _ in range(30_000)]
    text = b" ".join(words[w] for w in draw.integers(0, len(words), ppm.BATCH_BYTES // 6))
    grams, counts = np.unique(ppm.Layout([text]).grams(), return_counts=True)
    low = np.zeros((256, 256), np.int64)
    np.add.at(low, ((grams >> np.uint64(8) & np.uint64(255)).astype(int), (grams & np.uint64(255)).astype(int)), counts)
    tracemalloc.start()
    try:
        trie = ppm.Trie(grams, counts, low)
        model = grams.nbytes + counts.nbytes + tracemalloc.get_traced_memory()[1]
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        trie.score(ppm.Layout([text]), None)
        batch = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert model / len(grams) * ppm.SHARD_GRAMS + batch < 400e6


def test_ppm_odd_rows(odd, empty):
    got = ppm.score(odd).collect()
    assert len(got) == len(ROWS)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert all(np.isfinite([r.score, r.base_score]).all() and r.score <= 0 for r in got)
    assert ppm.score(empty).count() == 0


# --- 3: licenses ------------------------------------------------------------------------------------------------


def test_base_phrases(documents):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: r for r in licenses.scan(documents).collect()}
    for doc_id, text in texts(documents):
        words = word.findall(text.translate(low))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score < 1 and (r.score > 0) == bool(r.labels)


def test_templates():
    a = licenses.Automaton("under the <<optional>>terms of the<</optional>> <<x|y>> license <<var:2>> end")
    for text, end in (("under the x license end", 5), ("under the terms of the y license one two end", 10), ("under the z license end", -1), ("under the x license 1 2 3 end", -1), ("under the terms x license end", -1)):
        assert a.longest(text.encode().split(), 0) == end
    with pytest.raises(ValueError):
        licenses.Automaton("<<var:2>> end")


def test_license_odd_rows(odd, empty):
    got = licenses.scan(odd).collect()
    assert len(got) == len(ROWS)
    assert all((r.n_words, r.labels, r.first_word) == (0, "", None) for r in got if r.doc_id in (1, 2, 3))
    assert [r.labels for r in got if r.doc_id == 5] == ["mit"]
    assert licenses.scan(empty).count() == 0


# --- 4: unit hashing --------------------------------------------------------------------------------------------


def test_units_keep_their_first(documents):
    seen, want = set(), {}
    for doc_id, text in texts(documents):
        cut = [False] * len(text)
        for a, b, form in sorted(unitdedup.units(text)):
            if form in seen:
                cut[a:b] = [True] * (b - a)
            seen.add(form)
        want[doc_id] = "".join(c for c, x in zip(text, cut, strict=True) if not x)
    got = unitdedup.dedup(documents).collect()
    by_id = dict(texts(documents))
    assert {r.doc_id: r.kept for r in got} == want
    for r in got:
        assert r.n_chars_removed == sum(s.stop - s.start for s in r.spans) == len(by_id[r.doc_id]) - len(r.kept)


def test_units_odd_rows(odd, empty):
    got = unitdedup.dedup(odd).collect()
    assert len(got) == len(ROWS)
    assert [r.kept for r in got if r.doc_id == 7] == [""] and [r.kept for r in got if r.doc_id == 1] == [""]
    assert [r.kept for r in got if r.doc_id == 6 and r.n_removed] == ["other first line\n"] * 2
    assert unitdedup.dedup(empty).count() == 0


# --- 5: pivots --------------------------------------------------------------------------------------------------


def test_pivot_links(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    for k in range(300):
        v = base[k % 20] + rng.normal(size=16) * rng.uniform(0, 0.3)
        rows.append((100 + k, (v * rng.uniform(0.1, 9)).tolist()))
    rows += [(500, rows[0][1]), (501, None), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] * 16), (505, []), (506, [1.0, 2.0]), (None, [float("inf")] * 16)]
    got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v)) for i, v in rows if i is not None and (i < 501)]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    want = {good[k][0]: int(close[k].sum()) for k in range(len(good))}
    links = {r.vec_id: r.n_links for r in got}
    assert all(links[i] <= n for i, n in want.items())
    assert sum(links[i] for i in want) >= 0.9 * sum(want.values())
    for r in got:
        assert r.kept == (r.vec_id == r.component_id) or r.vec_id is None
        if r.vec_id is None or r.vec_id > 500:
            assert r.n_links == 0 and r.component_id == r.vec_id


@pytest.mark.parametrize("n_pivots", [64, 256, 257, 512, 2048])
def test_pivot_recall_near_the_threshold(spark, n_pivots):
    rng = np.random.default_rng(55)
    anchors, own, side = (rng.normal(size=(n, 64)) for n in (n_pivots, 400, 400))
    anchors, own = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (anchors, own))
    side -= (side * own).sum(1, keepdims=True) * own
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    copies = 0.951 * own + np.sqrt(1 - 0.951**2) * side
    rows = [(k, 1, v.tolist()) for k, v in enumerate(np.concatenate([own, copies]))]
    found = pivots.linked(spark.createDataFrame(rows, "node bigint, copies bigint, unit array<double>"), anchors).collect()
    links = {r.node for r in found}
    assert all(r.links == 1 for r in found) and len(found) == len(links)  # each pair is counted once
    assert len(links) >= 0.9 * len(rows)


def test_pivot_empty(spark):
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


# --- 6: lines ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_runs(spark, least):
    rng = np.random.default_rng(6)
    rows = [(k, "\n".join(rng.choice(["a", "b", "c c", "", "d"], size=rng.integers(1, 12)))) for k in range(40)]
    rows += [(90, rows[3][1]), (91, rows[3][1] + "\n" + rows[4][1])]
    seen, want = set(), {}
    for doc_id, text in rows:
        lines = text.split("\n")
        filled = [k for k, line in enumerate(lines) if line.strip(" ")]
        gone = set()
        for k in range(len(filled) - least + 1):
            run = tuple(lines[j] for j in filled[k : k + least])
            if run in seen:
                gone |= set(range(k, k + least))
            seen.add(run)
        cut, k = set(), 0
        while k < len(filled):
            if k in gone:
                start = k
                while k + 1 in gone:
                    k += 1
                cut |= set(range(filled[start], filled[k] + 1))
            k += 1
        want[doc_id] = "\n".join(line for j, line in enumerate(lines) if j not in cut)
    got = linedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), least).collect()
    assert {r.doc_id: r.kept for r in got} == want


def test_lines_odd_rows(odd, empty):
    got = linedup.dedup(odd).collect()
    assert len(got) == len(ROWS)
    assert [r.kept for r in got if r.doc_id == 1] == [None]
    assert {r.kept for r in got if r.doc_id == 6} == {"other first line", "another text under the same id"}
    assert linedup.dedup(empty).count() == 0


# --- 7: long repeats --------------------------------------------------------------------------------------------


def brute_repeats(rows):
    seen, want = set(), {}
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            piece = b[s : s + 100]
            if piece in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[doc_id] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return want


def test_long_repeats(documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in longrepeats.remove(documents).collect()}
    assert got == brute_repeats(texts(documents))


def test_long_repeats_leaves_texts_without_spans_in_place(spark, monkeypatch):
    moved = []

    def counted(rows, column, bits, inside):
        kept = common.where_marked(rows, column, bits, inside)
        moved.append((inside, kept.count()))
        return kept

    monkeypatch.setattr(longrepeats, "BROADCAST_LIMIT_BYTES", -1)
    monkeypatch.setattr(longrepeats, "where_marked", counted)
    rng = np.random.default_rng(11)
    make = lambda n: "".join(rng.choice(list("abcdé "), size=n))
    passage = make(150)
    rows = [(k, make(120)) for k in range(20)] + [(k, make(60) + passage + make(60)) for k in range(20, 24)]
    rows += [(30, rows[0][1]), (30, rows[0][1])]
    got = longrepeats.remove(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows[:-1])
    assert len(got) == len(rows)
    assert moved == [(True, 4), (True, 5), (False, 21)]


def test_long_repeats_of_one_batch_are_spread():
    a = longrepeats.Anchored([b"a" * 500, b"b" * 120, b"a" * 500, b"a" * 500])
    later = a.later(np.array([5, 1, 3, 3]), np.array([0, 0, 1, 1]))
    # of equal stretches only the first of the smallest id stays, twice if that document stands twice
    stays = {(int(o), int(p)) for o, p in zip(a.owner[~later], a.low[~later], strict=True) if o != 1}
    assert len(a.owner) > 1000 and stays and stays == {(o, p) for _, p in stays for o in (2, 3)} and len(stays) < 10
    assert not later[a.owner == 1][0]


def test_long_repeats_inside_and_between(spark, monkeypatch):
    monkeypatch.setattr(longrepeats, "HOT", 3)
    rng = np.random.default_rng(7)
    make = lambda n: "".join(rng.choice(list("abcdé "), size=n))
    passage = make(260)
    rows = [(k, make(80) + passage[rng.integers(0, 80) : rng.integers(150, 260)] + make(90)) for k in range(30)]
    rows += [(50, "ab" * 300), (51, "a" * 500), (52, passage * 3), (53, make(99)), (54, None)]
    got = longrepeats.remove(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows)


def test_long_repeats_odd_rows(odd, empty):
    got = longrepeats.remove(odd).collect()
    assert len(got) == len(ROWS)
    assert [r.n_removed for r in got if r.doc_id == 7] == [len(LONG)]
    assert longrepeats.remove(empty).count() == 0


def test_long_repeats_anchors_by_blocks(monkeypatch):
    rng = np.random.default_rng(12)
    texts = [bytes(rng.choice(list(b"ab"), size=n).astype(np.uint8)) for n in (99, 700, 0, 100, 320)] + [b"a" * 230, b""]
    whole = longrepeats.Anchored(texts)
    monkeypatch.setattr(longrepeats, "BLOCK", 53)
    parted = longrepeats.Anchored(texts)
    for name, values in vars(whole).items():
        assert values.tolist() == vars(parted)[name].tolist()
    starts = [(o, p) for o, low, high in zip(whole.owner, whole.low, whole.high, strict=True) for p in range(low, high + 1)]
    assert starts == [(k, p) for k, t in enumerate(texts) for p in range(len(t) - longrepeats.LENGTH + 1)]
    # the anchor is the leftmost gram of smallest hash in every string of its stretch
    anchor = {o: {} for o in range(len(texts))}
    for o, low, high, rel in zip(whole.owner, whole.low, whole.high, whole.rel, strict=True):
        anchor[o] |= {p: low + rel for p in range(low, high + 1)}
    for o, text in enumerate(texts):
        sums = longrepeats.rolled(np.frombuffer(text, np.uint8))
        for p, place in anchor[o].items():
            grams = np.arange(p, p + longrepeats.SPAN)
            hashes = longrepeats.stretches(sums, grams, grams + longrepeats.GRAM) >> np.uint64(16)
            assert place == p + int(np.argmin(hashes))


def test_long_repeats_hashes_stretches_of_kept_anchors_only(monkeypatch):
    hashed, stretches = [], longrepeats.stretches

    def counted(sums, starts, ends):
        hashed.append(len(starts))
        return stretches(sums, starts, ends)

    monkeypatch.setattr(longrepeats, "stretches", counted)
    text = bytes(np.random.default_rng(13).integers(32, 127, 20_000, dtype=np.uint8))
    found = len(longrepeats.Anchored([text]).anchor)
    assert sum(hashed) == 4 * found < len(text) / 2
    # the pass that counts anchors hashes nothing else
    hashed.clear()
    bare = longrepeats.Anchored([text], bare=True)
    assert sum(hashed) == len(bare.anchor) == found


def test_long_repeats_counts_anchors_by_batch(spark):
    rows = [(k, 0, "".join(chr(97 + (i * i + 7 * i) % 23) for i in range(300))) for k in range(40)]
    got = longrepeats.anchors(spark.createDataFrame(rows, "id bigint, tie bigint, text string").coalesce(1)).collect()
    one = longrepeats.Anchored([rows[0][2].encode()]).anchor
    assert {r.anchor for r in got} == set(one.tolist()) and sum(r.n for r in got) == 40 * len(one)
    assert len(got) == len(set(one.tolist()))


def test_matching_statistics_against_brute_force():
    rng = np.random.default_rng(14)
    for alphabet in (b"ab", b"abc", b"\x00\xfe\xff", bytes(range(256))):
        make = lambda n: bytes(rng.choice(list(alphabet), size=n).astype(np.uint8))  # noqa: B023, E731
        core = make(40)
        strings = [make(rng.integers(0, 40)) + core[rng.integers(0, 20) :] for _ in range(5)] + [b""]
        patterns = [make(9) + core[:30] + make(9), strings[0], b"", strings[1] * 2]
        index = rlindex.RunIndex(strings)
        for most in (None, 8):
            for p, lengths in zip(patterns, index.matching_statistics(patterns, most), strict=True):
                want = [max(n for n in range(len(p) - j + 1) if any(p[j : j + n] in s for s in strings)) for j in range(len(p))]
                assert lengths.tolist() == [min(n, most or n) for n in want]


def test_matching_statistics():
    rng = np.random.default_rng(8)
    for alphabet in (b"ab", bytes(range(256))):
        strings = [bytes(rng.choice(list(alphabet), size=rng.integers(1, 60)).astype(np.uint8)) for _ in range(6)]
        patterns = [bytes(rng.choice(list(alphabet), size=40).astype(np.uint8)), strings[0][1:] + strings[1], strings[2]]
        patterns = [p for p in patterns if p]
        for p, lengths in zip(patterns, rlindex.RunIndex(strings).matching_statistics(patterns), strict=True):
            for j, n in enumerate(lengths):
                assert any(p[j : j + n] in s for s in strings)
                assert j + n == len(p) or not any(p[j : j + n + 1] in s for s in strings)


# --- 8: mixing --------------------------------------------------------------------------------------------------


def test_mix_meets_its_targets(documents):
    rows = mixing.mix(documents).collect()
    by_source = defaultdict(list)
    for r, s in ((r, {d.doc_id: d.source for d in documents.select("doc_id", "source").collect()}) for r in rows):
        by_source[s[r.doc_id]].append(r)
    total = sum(r.size for r in rows)
    assert sum(group[0].target for group in by_source.values()) == pytest.approx(1.5 * total)
    for group in by_source.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= max(r.size for r in group)
        assert all(r.taken <= 2 * r.size for r in group)


def test_mix_odd_rows(odd, empty):
    first = sorted(map(str, mixing.mix(odd).collect()))
    assert len(first) == len(ROWS) and first == sorted(map(str, mixing.mix(odd.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(odd.filter("text is null")).first().taken == 0


# --- 9: Jaccard join --------------------------------------------------------------------------------------------


def shingle_words(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingle_words(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = {}
    for k, (doc_id, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), 10**9), doc_id)
    return {doc_id: (len(sets[k]), low[find(k)]) for k, (doc_id, _) in enumerate(rows)}


def edited_copies():
    rng = np.random.default_rng(9)
    word = lambda: f"v{rng.integers(0, 400)}"
    rows = []
    for base in range(4):
        words = [word() for _ in range(int(rng.integers(30, 120)))]
        for _ in range(25):
            copy = list(words)
            for _ in range(int(rng.integers(0, 6))):
                copy[int(rng.integers(0, len(copy)))] = word()
            rows.append((len(rows), " ".join(copy)))
    shared = " ".join(word() for _ in range(40))
    rows += [(len(rows) + k, shared + " " + " ".join(word() for _ in range(int(rng.integers(0, 12))))) for k in range(40)]
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = edited_copies()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def shared_cores():
    """Pairs about the threshold whose only shared lists are led by longer documents that are similar to neither."""
    rng = np.random.default_rng(17)
    fresh = iter(range(10**6))
    new = lambda n: [f"u{next(fresh)}" for _ in range(int(n))]
    common = [new(60) for _ in range(6)]
    rows = [" ".join(c + new(150)) for c in common for _ in range(8)]
    for _ in range(60):
        core = new(rng.integers(60, 110))
        tail = len(core) * rng.uniform(0.08, 0.14)
        often = common[int(rng.integers(0, 6))]
        rows.append(" ".join(core + often[: int(tail)]))
        rows.append(" ".join(new(tail - rng.integers(0, 3)) + core))
        for _ in range(int(rng.integers(1, 4))):
            rows.append(" ".join(core + new(len(core) * rng.uniform(0.3, 0.6)) + often[: int(rng.integers(5, 40))]))
    return list(enumerate(rows))


def test_pairs_about_the_threshold_beside_longer_documents(spark):
    rows = shared_cores()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_pairs_are_met_when_tokens_look_alike():
    """Two tokens of a set with the same 16 bits are two tokens: a pair that shares both is not lost."""
    side = {"group": np.array([1]), "n": np.array([10]), "matches": np.array([3]), "length": np.array([3]), "last": np.array([5])}
    alike = [np.array([7, 7, 3], np.int16)]
    src, dst = jaccard._close(side | {"node": np.array([2]), "tokens": alike}, side | {"node": np.array([1]), "group": np.array([2]), "tokens": alike})
    assert (src.tolist(), dst.tolist()) == ([2], [1])


def test_rows_without_a_partner_stay_out_of_the_shuffle(spark):
    rows = spark.range(200_000).selectExpr("id AS token", "cast(id % 7 AS int) AS cell")
    keys = rows.filter("token % 100 = 0")
    near = jaccard.marked(rows, keys, ["token", "cell"])
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.join(keys, ["token", "cell"]).count() == 2_000
    assert near.count() < 20_000


def test_near_duplicates_odd_rows(odd, empty):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    assert [r.component_id for r in got if r.doc_id == 7] == [4]
    assert {r.n_shingles for r in got if r.doc_id in (1, 2, 3)} == {0}
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 2
    assert jaccard.near_duplicates(empty).count() == 0


# --- 10: toxicity -----------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.85


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (8, None), (77, 1), (6, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == len(ROWS)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    nothing = toxicity.train(empty, labels.limit(0))
    assert [r.predicted for r in toxicity.score(odd, nothing).collect()] == [0] * len(ROWS)
    assert toxicity.score(empty, model).count() == 0
