"""Benchmark decontamination: passages query a BM25 index of the test items by block-max WAND, then overlap decides."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import byte_texts, doc_id, real_id, text_batches, text_or_empty, tie

#: BM25 settings; share of an item's score against itself that a passage must reach.
K1, B, LEAST = 1.2, 0.75, 0.7
#: Items per block of the index, and bytes of items that one index (one pass over the documents) holds.
BLOCK_ITEMS, INDEX_BYTES = 8, 32 << 20
#: Items are indexed by length class, each up to twice as long as the last; the shortest class has so many words.
SHORTEST = 16
#: Shingle words and the share of an item's question and answer shingles that a passage must hold.
SHINGLE, OVERLAP = 5, 0.8

#: Everything in ASCII but letters and digits parts words; upper case is lowered.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
SENTENCE = re.compile(rb"(?<=[.!?])\s+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Words of all but the last sentence, and of the last one; of a single sentence the last third is the answer."""
    cuts = [m.end() for m in SENTENCE.finditer(text.strip())]
    words = words_of(text)
    tail = len(words_of(text.strip()[cuts[-1] :])) if cuts else 0
    if not cuts or tail in (0, len(words)):
        tail = max(1, len(words) // 3)
    return words[: len(words) - tail], words[len(words) - tail :]


class Index:
    """Impacts of the items of one length class: an inverted index in blocks, with the largest impact per block.

    The impact of a term in an item is its BM25 weight over the item's score against itself, so one
    threshold holds for all items. Postings are in item order; blocks are ``BLOCK_ITEMS`` items.
    """

    def __init__(self, parted: list[tuple], weights: dict[bytes, float], mean: float):
        self.ids, items = [p[0] for p in parted], [p[1] for p in parted]
        self.parts = [(shingles(p[2]), shingles(p[3])) for p in parted]
        #: Words of a stretch: what no item of the class reaches, whichever items there are.
        self.size = 1 << max(SHORTEST, max(map(len, items))).bit_length()
        self.terms: dict[bytes, int] = {}
        rows: list[dict[int, float]] = []
        for words in items:
            counts: dict[bytes, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            scores = {w: weights[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean)) for w, n in counts.items()}
            own = sum(scores.values())
            rows.append({self.terms.setdefault(w, len(self.terms)): x / own for w, x in scores.items()})
        n_blocks = -(-len(items) // BLOCK_ITEMS)
        self.impacts = np.zeros((len(self.terms) + 1, n_blocks * BLOCK_ITEMS), np.float32)
        for at, row in enumerate(rows):
            for term, x in row.items():
                self.impacts[term, at] = x
        self.block_max = self.impacts.reshape(len(self.terms) + 1, n_blocks, BLOCK_ITEMS).max(2)
        self.term_max = self.block_max.max(1).astype(np.float64)


class Searcher:
    """Block-max WAND over the indexes of all length classes, then the overlap check."""

    def __init__(self, items: list[tuple[int, bytes]]):
        parted = [(i, words_of(t), *question_and_answer(t)) for i, t in items]
        parted = [p for p in parted if p[1]]
        seen: dict[bytes, int] = {}
        for _, words, _, _ in parted:
            for w in set(words):
                seen[w] = seen.get(w, 0) + 1
        total = len(parted)
        weights = {w: float(np.log(1 + (total - n + 0.5) / (n + 0.5))) for w, n in seen.items()}
        mean = sum(len(p[1]) for p in parted) / max(total, 1)
        classes: dict[int, list[tuple]] = {}
        for p in sorted(parted, key=lambda p: (len(p[1]), p[0])):
            classes.setdefault(max(SHORTEST, len(p[1])).bit_length(), []).append(p)
        self.indexes = [Index(c, weights, mean) for c in classes.values()]
        self.vocabulary = {w: k for k, w in enumerate(weights)}
        self.maps = []
        for index in self.indexes:
            at = np.full(len(self.vocabulary) + 1, len(index.terms), np.int64)
            for w, k in index.terms.items():
                at[self.vocabulary[w]] = k
            self.maps.append(at)

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int, float, float, float]]]:
        """For each text (item, first word, end, score, question share, answer share) of every item that a passage repeats."""
        found: list[dict[int, tuple]] = [{} for _ in texts]
        if not self.indexes:
            return [[] for _ in texts]
        get, none = self.vocabulary.get, len(self.vocabulary)
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.fromiter(map(get, chain.from_iterable(words), repeat(none)), np.int64, int(sizes.sum()))
        for index, at in zip(self.indexes, self.maps, strict=True):
            self._one_index(index, at[codes], sizes, words, found)
        return [sorted(f.values()) for f in found]

    def _one_index(self, index: Index, terms: np.ndarray, sizes: np.ndarray, words: list[list[bytes]], found: list[dict]) -> None:
        """Passages of two stretches of ``index.size`` words may start at any word; each lies whole in a window of three.

        Windows start at every stretch. What a passage scores, its window does, so windows retrieve and passages decide.
        """
        stretches = np.maximum(-(-sizes // index.size), 1)
        first = np.concatenate([[0], np.cumsum(stretches)])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        stretch = first[owner] + (np.arange(len(terms)) - begins[owner]) // index.size
        known = terms < len(index.terms)
        stretch, term = np.divmod(np.unique(stretch[known] * len(index.terms) + terms[known]), len(index.terms))
        # WAND: a passage whose terms cannot reach the threshold in any item is skipped
        most = np.bincount(stretch, weights=index.term_max[term], minlength=first[-1] + 2)
        able = np.flatnonzero(most[:-2] + most[1:-1] + most[2:] >= LEAST - 1e-5)
        starts = np.searchsorted(stretch, able)
        ends = np.searchsorted(stretch, able + 3)
        docs = np.searchsorted(first, able, side="right") - 1
        for k, doc, i, j in zip(able.tolist(), docs.tolist(), starts.tolist(), ends.tolist(), strict=True):
            if k + 3 > first[doc + 1]:
                if k > first[doc]:
                    continue  # the window before holds all of this one
                j = int(np.searchsorted(stretch, first[doc + 1]))
            # block-max: only blocks whose largest impacts add up to the threshold are opened
            query = term[i:j]
            blocks = np.flatnonzero(index.block_max[query].sum(0) >= LEAST - 1e-5)
            if not len(blocks):
                continue
            query = np.unique(query)
            a = (k - int(first[doc])) * index.size
            for at in blocks * BLOCK_ITEMS:
                scores = index.impacts[query, at : at + BLOCK_ITEMS].sum(0)
                for item in np.flatnonzero(scores >= LEAST - 1e-5).tolist():
                    self._verify(index, int(at) + item, a, min(a + 3 * index.size, len(words[doc])), words[doc], found[doc])

    def _verify(self, index: Index, place: int, a: int, b: int, words: list[bytes], found: dict[int, tuple]) -> None:
        item, (question, answer) = index.ids[place], index.parts[place]
        if held(question, words[a:b]) < OVERLAP or held(answer, words[a:b]) < OVERLAP:
            return
        for first, end, score, asked, told in passages(index, place, words, a, b):
            if score >= LEAST - 1e-5 and asked >= OVERLAP and told >= OVERLAP and (item not in found or (-score, first) < (-found[item][3], found[item][1])):
                found[item] = (item, first, end, score, asked, told)


def passages(index: Index, place: int, words: list[bytes], a: int, b: int) -> Iterator[tuple[int, int, float, float, float]]:
    """(first word, end, score, question share, answer share) of each passage of two stretches within words ``a`` to ``b``."""
    width = min(2 * index.size, b - a)
    impact = {w: float(x) for w, k in ((w, index.terms.get(w)) for w in set(words[a:b])) if k is not None and (x := index.impacts[k, place]) > 0}
    # what stands in a passage, with counts: the item's words, the shingles of its question and those of its answer
    parts = [(1, impact), *((n, dict.fromkeys(wanted, 1.0)) for n, wanted in index.parts[place])]
    totals = [1.0, *(float(len(wanted)) for _, wanted in index.parts[place])]
    counts, sums = [{} for _ in parts], [0.0] * len(parts)

    def change(kind: int, at: int, by: int) -> None:
        n, worth = parts[kind]
        key = words[at] if kind == 0 else tuple(words[at : at + n])
        if n and key in worth:
            left = counts[kind].get(key, 0) + by
            counts[kind][key] = left
            if left == (by > 0):
                sums[kind] += by * worth[key]

    for kind, (n, _) in enumerate(parts):
        for at in range(a, a + width - n + 1):
            change(kind, at, 1)
    for first in range(a, b - width + 1):
        if first > a:
            for kind, (n, _) in enumerate(parts):
                if 0 < n <= width:
                    change(kind, first - 1, -1)
                    change(kind, first + width - n, 1)
        score, asked, told = (x / total if total else 1.0 for x, total in zip(sums, totals, strict=True))
        yield first, first + width, round(score, 6), asked, told


def runs(words: list[bytes], n: int) -> frozenset[tuple[bytes, ...]]:
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def shingles(words: list[bytes]) -> tuple[int, frozenset[tuple[bytes, ...]]]:
    """Words per shingle, five or all there are, and the distinct shingles."""
    n = min(SHINGLE, len(words))
    return n, runs(words, n) if n else frozenset()


def held(part: tuple[int, frozenset[tuple[bytes, ...]]], passage: list[bytes]) -> float:
    """Share of the shingles that stand in the passage; an empty part is held."""
    n, wanted = part
    return len(wanted & runs(passage, n)) / len(wanted) if wanted else 1.0


HITS = "id bigint, tie bigint, item_id bigint, first_word bigint, end_word bigint, score double, question_overlap double, answer_overlap double"


def item_shards(items: DataFrame, most: int = INDEX_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The test items in shares of at most ``most`` bytes, so that no index outgrows an executor."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), text_or_empty().alias("text")).filter("item_id is not null").distinct()
    shard, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        data = row.text.encode("utf-8", "replace")
        if shard and size + len(data) > most:
            yield shard
            shard, size = [], 0
        shard.append((row.item_id, data))
        size += len(data)
    if shard:
        yield shard


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, tie, item_id, first_word, end_word, score, question_overlap, answer_overlap) of every repeated item.

    Every passage of every whole text, from any word on, is a query; a passage has twice the words of the longest
    item that the item's length class may hold. All items whose score reaches ``LEAST`` of their own are retrieved and kept if ``OVERLAP`` of the shingles of the question (all sentences but the last) and of
    the answer (the last one) stand in the passage. The best passage per item is reported, the first of equals.
    The items are indexed in shares of a fixed size; the documents are read once per share and not moved.
    Null and empty texts and items hit nothing; repeated items give one hit, items that share an id are each
    looked for and the best is reported.
    """
    rows = docs.select(doc_id().alias("id"), tie().alias("tie"), text_or_empty().alias("text"))
    result = None
    for shard in item_shards(items):
        shipped = docs.sparkSession.sparkContext.broadcast(shard)  # at most INDEX_BYTES, or one item

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shipped.value)
            for batch in text_batches(batches):
                owner, out = [], []
                for row, own in enumerate(searcher.search(byte_texts(batch))):
                    owner += [row] * len(own)
                    out += own
                at = pa.array(owner, pa.int64())
                kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    names=["id", "tie", "item_id", "first_word", "end_word", "score", "question_overlap", "answer_overlap"],
                )

        part = rows.mapInArrow(run, HITS)
        result = part if result is None else result.unionByName(part)
    return result if result is not None else rows.sparkSession.createDataFrame([], HITS)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``hits`` by doc_id, a row per document and item."""
    return hits(docs, items).withColumn("doc_id", real_id()).select(
        "doc_id", "item_id", "first_word", "end_word", "score", "question_overlap", "answer_overlap"
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose text repeats no test item; same rules as ``hits``, nothing is moved."""
    kept = docs
    for shard in item_shards(items):
        shipped = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shipped.value)
            for batch in text_batches(batches):
                yield batch.filter(pa.array([not own for own in searcher.search(byte_texts(batch))], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
