"""Spelling variant grouping: words one edit apart, found in a bidirectional FM-index, point to their most frequent neighbour."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import positioned, text_batches, text_or_empty, written
from cliptide.llm.fmindex import Index, Words
from cliptide.session import broadcast_when_small

SHORTEST, FEWEST, RATIO = 5, 3, 2
#: One occurrence in so many, by the digest of document and word, loses a letter.
SLIP = 97
#: Words of an index shard, and queries that a task searches in it.
SHARD_WORDS, SHARD_QUERIES = 50_000, 200_000
#: Words that a task holds before it sends their counts, and the longest words whose digests are combined in arrays.
HELD_WORDS, ARRAY_BYTES = 400_000, 63

CRC_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def slip(word: str, digest: int) -> str:
    place = digest % len(word)
    return word[:place] + word[place + 1 :]


def runs(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs of letters of lower-cased texts as a dictionary array, and the text of each. U+00C0 to U+00FF are C3 and a byte."""
    raw = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    inside = (raw >= 0x61) & (raw <= 0x7A)
    lead = raw == 0xC3
    inside |= lead
    inside[1:] |= lead[:-1]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    texts_end = np.cumsum([len(t) + 1 for t in texts])
    return words.dictionary_encode(), np.searchsorted(texts_end, starts, side="right")


def digests(ids: list[bytes], owner: np.ndarray, words: list[bytes], number: np.ndarray) -> np.ndarray:
    """crc32 of ``<id>:<word>`` of every occurrence.

    The digest of a text and a continuation is the digest of the continuation, combined with that of the text
    carried over as many zero bytes; so words are read once each and documents once per length of a word.
    """
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    heads = [i + b":" for i in ids]
    carried = np.zeros((min(int(sizes.max(initial=0)), ARRAY_BYTES) + 1, len(ids)), np.uint32)
    carried[0] = [zlib.crc32(h) for h in heads]
    for k in range(1, len(carried)):
        carried[k] = CRC_STEP[carried[k - 1] & np.uint32(255)] ^ (carried[k - 1] >> np.uint32(8))
    size = sizes[number]
    found = carried[np.minimum(size, len(carried) - 1), owner] ^ own[number]
    for k in np.flatnonzero(size >= len(carried)).tolist():
        found[k] = zlib.crc32(words[number[k]], zlib.crc32(heads[owner[k]]))
    return found


def counts_of(ids: list[bytes], texts: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) in some texts after the slips, with words of fewer than ``SHORTEST`` letters left out."""
    found, owner = runs(texts)
    words, number = found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)
    digest = digests(ids, owner, words, number)
    slipped = digest % np.uint32(SLIP) == 0
    plain = np.bincount(number[~slipped], minlength=len(words))
    for word, n in zip(words, plain.tolist(), strict=True):
        if n and len(word) >= SHORTEST and len(word) - word.count(b"\xc3") >= SHORTEST:
            yield word, n
    changed = Counter(zip(number[slipped].tolist(), digest[slipped].tolist(), strict=True))
    for (which, h), n in changed.items():
        word = slip(words[which].decode(), h)
        if len(word) >= SHORTEST:
            yield word.encode(), n


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words with ``FEWEST`` occurrences. A null text has no words; a null id counts as an empty one."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary").alias("id"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in text_batches(batches):
            for word, n in counts_of(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held[word] += n
            if len(held) >= HELD_WORDS:
                yield sent()
                held = Counter()
        yield sent()

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= FEWEST)


def half(word: str) -> int:
    return len(word) // 2


def asked_shards(words: DataFrame, borders: dict[bool, list[str]]) -> DataFrame:
    """(right, shard, word): the shards that may hold words with the first, or last, half of a word.

    A shard is a range of the words, or of the words read backwards, so a half leads to a range of shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides, shards, asked = [], [], []
            for word in batch.column(0).to_pylist():
                for right, key in ((True, word[: half(word)]), (False, word[half(word) :][::-1])):
                    first = max(bisect_right(borders[right], key) - 1, 0)
                    last = bisect_right(borders[right], key + "\U0010ffff")
                    for shard in range(first, last):
                        sides.append(right)
                        shards.append(shard)
                        asked.append(word)
            yield pa.RecordBatch.from_arrays([pa.array(sides, pa.bool_()), pa.array(shards, pa.int64()), pa.array(asked, pa.string())], names=["right", "shard", "word"])

    return words.select("word").mapInArrow(run, "right boolean, shard bigint, word string")


NEAR = "word string, n_near bigint, form_n bigint, form string"


def searched(key: tuple, indexed: pa.Table, asked: pa.Table) -> pa.Table:
    """Per query with a near word in the shard: how many, and the most frequent, ties to the first."""
    right = key[0].as_py()
    indexed = indexed.sort_by("word")  # by bytes of UTF-8, which is by code point
    words, counts = indexed.column("word").to_pylist(), indexed.column("n").to_numpy()
    queries = asked.column("word").to_pylist()
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
    if not words or not queries:
        return schema.empty_table()
    index = Index(words)
    first = np.array([half(q) for q in queries], np.int64)
    whole = np.array([len(q) for q in queries], np.int64)
    rows, near = index.near(queries, first if right else whole - first, right)
    if not right:  # what also shares the first half is found from there
        new = ~index.same_start(Words(queries, index.symbols), rows, near, first)
        rows, near = rows[new], near[new]
    order = np.lexsort((near, -counts[near], rows))
    rows, near = rows[order], near[order]
    best = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(best, len(rows)))
    return pa.table(
        [
            pa.array([queries[q] for q in rows[best].tolist()], pa.string()),
            pa.array(sizes, pa.int64()),
            pa.array(counts[near[best]], pa.int64()),
            pa.array([words[w] for w in near[best].tolist()], pa.string()),
        ],
        schema=schema,
    )


def nearest(words: DataFrame, shard_words: int = SHARD_WORDS, shard_queries: int = SHARD_QUERIES) -> DataFrame:
    """(word, n, n_near, form_n, form) of each of ``words`` (word, n): how many near words, and the first of them.

    Two scheme sides: in shards of the sorted vocabulary the first half of a query is matched and extended to the right with one
    error, in shards of the words sorted from their ends the second half to the left. A shard with many queries is
    searched by several tasks. Every near word lies in one shard of one side, so tasks send one row per query and no pairs.
    """
    sides = [
        positioned(words.withColumn("key", key), [F.col("key")]).select(
            F.lit(right).alias("right"), F.floor(F.col("pos") / shard_words).cast("bigint").alias("shard"), "key", "word", "n"
        )
        for right, key in ((True, F.col("word")), (False, F.reverse("word")))
    ]
    indexed = written(sides[0].unionByName(sides[1]))
    # one row per shard of SHARD_WORDS words
    starts = indexed.groupBy("right", "shard").agg(F.min("key").alias("key")).collect()
    borders = {side: [r.key for r in sorted((r for r in starts if r.right == side), key=lambda r: r.shard)] for side in (True, False)}
    asked = written(asked_shards(words, borders))
    parts = written(
        asked.groupBy("right", "shard").agg(F.ceil(F.count("*") / shard_queries).cast("int").alias("parts"))
    )
    few = broadcast_when_small(parts, 64)
    left = indexed.join(few, ["right", "shard"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    queries = asked.join(few, ["right", "shard"]).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    keys = ["right", "shard", "part"]
    tasks = 2 * max(len(starts), 1)
    near = (
        left.select(*keys, "word", "n").repartition(tasks, *keys).groupBy(*keys)
        .cogroup(queries.select(*keys, "word").repartition(tasks, *keys).groupBy(*keys))
        .applyInArrow(searched, NEAR)
    )
    own = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("form_n"), F.lit(None).cast("string").alias("form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    return (
        own.unionByName(near.withColumn("n", F.lit(None).cast("bigint")))
        .groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")
    )


def roots(pointers: DataFrame) -> DataFrame:
    """(word, root) for (word, form) with a form each: the end of the chain, by pointer doubling.

    A form is at least ``RATIO`` times as frequent as its word, so chains have as many steps as the largest count has
    binary digits, and the rounds the logarithm of that.
    """
    now = written(pointers.select("word", F.col("form").alias("root")))
    while True:
        # only words that others point at are asked for
        goals = now.select(F.col("root").alias("word")).distinct().join(now, "word").select(F.col("word").alias("root"), F.col("root").alias("next"))
        goals = written(goals)
        if goals.isEmpty():
            return now
        now = written(now.join(broadcast_when_small(goals, 400), "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def group(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    Words are runs of Latin letters of whole texts, A-Z lowered. Repeated rows count as often as they stand; columns
    other than ``doc_id`` and ``text`` are ignored; an empty table has no words. A word of any length is taken whole.
    """
    words = written(vocabulary(docs))
    near = nearest(words)
    fits = F.coalesce(F.col("form_n") >= RATIO * F.col("n"), F.lit(False))
    table = written(near.select("word", "n", "n_near", F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    ends = roots(table.filter(F.col("form").isNotNull()).select("word", "form"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
