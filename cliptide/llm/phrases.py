"""Phrase collocation mining by SON partitioning: shards are mined alone, what is frequent in any is counted over all."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cliptide.llm.common import byte_texts, text_batches, text_or_empty, written
from cliptide.llm.shingles import FACTOR, mixed
from cliptide.session import broadcast_when_small

SUPPORT, LONGEST, TOP = 100, 5, 2000
#: Bytes of text that are mined together at most, and bytes that are parted into words at once.
SHARD_BYTES, SLICE_BYTES = 32 << 20, 4 << 20
#: Cells that digests fall into, in blocks; a bit per cell (8 MB) carries the union of the shards to all tasks.
BLOCKS, BLOCK_CELLS = 1024, 1 << 16
#: Tasks whose reports are added up at once.
ADDED_TOGETHER = 256
#: Lengths that are mined together; a later step looks only at phrases whose parts passed the steps before.
STEPS = ((1,), (2,), (3, 4, 5))
NO_LANG = "und"

#: 0: part of a word, 1: parts words, 2: parts pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2

Accept = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def slices(texts: list[bytes], most: int) -> Iterator[bytes]:
    """Texts joined by line ends into parts of about ``most`` bytes; a longer text is cut between pieces, which no phrase crosses."""
    held, size = [], 0
    for text in texts:
        at = 0
        while len(text) - at > most:
            cut = max(text.rfind(mark, at, at + most) for mark in (b".", b",", b"\n"))
            if cut < 0:
                found = [p for p in (text.find(mark, at + most) for mark in (b".", b",", b"\n")) if p >= 0]
                cut = min(found, default=len(text))  # one piece is never cut
            yield text[at:cut]
            at = min(cut + 1, len(text))
        held.append(text[at:])
        size += len(text) - at
        if size >= most:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def parted(data: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of lower-cased text as a dictionary array, and whether the next word stands in the same piece."""
    raw = np.frombuffer(data.lower(), np.uint8)
    kind = KIND[raw]
    inside = kind == 0
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    return words.dictionary_encode(), np.append(piece[1:] == piece[:-1], False)[: len(starts)]


@dataclass
class Shard:
    """Word numbers of a shard's texts in order, and where the next word belongs to the same piece."""

    words: list[bytes]
    numbers: np.ndarray
    follows: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Shard:
        known: dict[bytes, int] = {}
        numbers, follows = [np.zeros(0, np.int32)], [np.zeros(0, bool)]
        for part in slices(texts, SLICE_BYTES):
            found, same = parted(part)
            to = np.array([known.setdefault(w, len(known)) for w in found.dictionary.to_pylist()], np.int32)
            numbers.append(to[found.indices.to_numpy()])
            follows.append(same)
        return cls(list(known), np.concatenate(numbers), np.concatenate(follows))

    def mined(self, seed: int, accept: Accept, spelled: bool, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
        """Per length: digests, counts and, if ``spelled``, texts of the phrases that ``accept`` takes.

        A phrase is looked at only where both its parts that are one word shorter were taken, so
        ``accept`` has to be monotone. Phrases are told apart by number of the shorter phrase and
        number of the last word, hence exactly; digests only serve ``accept``.
        """
        if not len(self.numbers):
            return
        word_digests = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], np.uint64)
        counts, digests, texts = np.bincount(self.numbers, minlength=len(self.words)), mixed(word_digests), self.words
        taken = accept(1, digests, counts)
        yield 1, digests[taken], counts[taken], [texts[g] for g in np.flatnonzero(taken)] if spelled else []
        at = np.arange(len(self.numbers), dtype=np.int32)  # where phrases of the present length start, and their numbers
        group = self.numbers
        for length in range(2, longest + 1):
            good = taken[group]
            at, group = at[good], group[good]
            starts = np.zeros(len(self.numbers) + 1, bool)
            starts[at] = True
            good = starts[at + 1] & self.follows[at]
            at, group = at[good], group[good]
            if not len(at):
                return
            keys = group.astype(np.int64) << 32
            keys |= self.numbers[at + (length - 1)]
            order = np.argsort(keys)
            keys = keys[order]
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts = np.diff(np.append(cuts, len(keys)))
            group = np.empty(len(keys), np.int32)
            group[order] = np.repeat(np.arange(len(cuts), dtype=np.int32), counts)
            keys = keys[cuts]
            del order
            shorter, last = keys >> 32, keys & 0xFFFFFFFF
            digests = mixed(digests[shorter] * np.uint64(FACTOR) + word_digests[last])
            taken = accept(length, digests, counts)
            chosen = np.flatnonzero(taken)
            if spelled:
                pairs = zip(chosen.tolist(), shorter[chosen].tolist(), last[chosen].tolist(), strict=True)
                texts = {g: texts[s] + b" " + self.words[w] for g, s, w in pairs}
            yield length, digests[chosen], counts[chosen], list(texts.values()) if spelled else []


def shards(batches: Iterator[pa.RecordBatch], extra: str | None = None) -> Iterator[tuple[str, object, int, Shard]]:
    """(lang, value of ``extra``, bytes, shard) for the texts of a task, a shard for each ``SHARD_BYTES`` and language."""
    held: dict[str, list[bytes]] = {}
    values: dict[str, object] = {}
    size = 0

    def sent():
        for lang, texts in held.items():
            yield lang, values.get(lang), sum(map(len, texts)), Shard.of(texts)

    for batch in text_batches(batches, SLICE_BYTES):
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        if extra is not None:
            values.update(zip(langs, batch.column(batch.schema.get_field_index(extra)).to_pylist(), strict=True))
        for lang, text in zip(langs, byte_texts(batch), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
        if size >= SHARD_BYTES:
            yield from sent()
            held, size = {}, 0
    yield from sent()


def seed_of(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


class Filter:
    """Phrases by a bit for the cell of their digest: what was put in is always found, others seldom."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, digests: np.ndarray) -> np.ndarray:
        block, cell = places(digests)
        return (self.bits[block, cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1

    @classmethod
    def empty(cls) -> Filter:
        return cls(np.zeros((BLOCKS, BLOCK_CELLS // 8), np.uint8))


def places(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block of a digest and its cell in the block."""
    return ((digests >> np.uint64(16)) % np.uint64(BLOCKS)).astype(np.int64), (digests & np.uint64(BLOCK_CELLS - 1)).astype(np.int64)


def packed(cells: np.ndarray, above: np.ndarray) -> bytes:
    return cells.astype(np.uint16).tobytes() + np.minimum(above, (1 << 31) - 1).astype(np.int32).tobytes()


def summed(reports: list[bytes]) -> np.ndarray:
    """Sum of packed reports of one block, cell by cell."""
    total = np.zeros(BLOCK_CELLS, np.int64)
    for report in reports:
        n = len(report) // 6
        total[np.frombuffer(report, np.uint16, n)] += np.frombuffer(report, np.int32, n, 2 * n)
    return total


REPORT = "lang string, block int, part bigint, lacking bigint, cells binary"


def locally_frequent(docs: DataFrame, support: int, lengths: tuple[int, ...], known: Filter) -> DataFrame:
    """``REPORT`` rows: what each shard has of its frequent phrases of some lengths, and what it can lack of others.

    A shard with the share p of its language's bytes asks for p * ``support`` occurrences, rounded up. The shares
    of a language add up to 1, so a phrase with ``support`` occurrences reaches its part in one shard at least.
    A shard that does not report a phrase has fewer than it asks for; so what the reporting shards have above that, added up,
    must fill what the others can lack. Reports are sent by block of cells, so their rows follow the number of shards.
    Phrases that share a cell are added up, which may let more pass but nothing less. Shorter phrases must be in ``known``.
    """
    totals = written(docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = shared.value, TaskContext.get().partitionId()
        for lang, total, size, shard in shards(batches, "bytes"):
            local = max(-(-support * size // int(total)), 1) if total else 1

            def accept(length: int, digests: np.ndarray, counts: np.ndarray, local: int = local) -> np.ndarray:
                return counts >= local if length >= lengths[0] else before.has(digests)

            cells, above = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for length, digests, counts, _ in shard.mined(seed_of(lang), accept, False, lengths[-1]):
                if length in lengths:
                    block, cell = places(digests)
                    cells.append(block * BLOCK_CELLS + cell)
                    above.append(counts - (local - 1))
            cell, which = np.unique(np.concatenate(cells), return_inverse=True)
            sums = np.bincount(which, np.concatenate(above), len(cell)).astype(np.int64)
            blocks, starts = np.unique(cell // BLOCK_CELLS, return_index=True)
            reports = [packed(c % BLOCK_CELLS, a) for c, a in zip(np.split(cell, starts[1:]), np.split(sums, starts[1:]), strict=True)] if len(blocks) else []
            n = len(blocks) + 1
            columns = [
                pa.array([lang] * n, pa.string()),
                pa.array([-1, *blocks.tolist()], pa.int32()),
                pa.array([part] * n, pa.int64()),
                pa.array([local - 1] + [0] * (n - 1), pa.int64()),
                pa.array([b"", *reports], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "block", "part", "lacking", "cells"])

    return docs.join(broadcast_when_small(totals, 256), "lang").mapInArrow(run, REPORT)


def added_up(rows: DataFrame, add: Callable[[pa.Table], dict[str, pa.Array]], schema: str) -> DataFrame:
    """One row per language and block of packed rows (lang, block, part, ...) that ``add`` merges.

    One task merges what at most ``ADDED_TOGETHER`` tasks sent for a block, level by level.
    """

    def merge(table: pa.Table) -> pa.Table:
        first = {name: table.column(column).slice(0, 1) for name, column in (("lang", "lang"), ("block", "block"), ("part", "group"))}
        return pa.table(first | add(table))

    last = rows.agg(F.coalesce(F.max("part"), F.lit(0)).alias("last")).first().last
    while True:
        grouped = rows.withColumn("group", F.floor(F.col("part") / ADDED_TOGETHER).cast("bigint"))
        rows = grouped.groupBy("lang", "block", "group").applyInArrow(merge, schema)
        last //= ADDED_TOGETHER
        if last == 0:
            return rows


def passed(reports: DataFrame, support: int) -> Filter:
    """The cells whose reports, with what the other shards can lack, reach ``support`` in some language.

    What reaches the driver is a bit per cell.
    """
    reports = written(reports)
    lacking = reports.groupBy("lang").agg(F.sum("lacking").alias("lacking"))

    def add(table: pa.Table) -> dict[str, pa.Array]:
        total = summed(table.column("cells").to_pylist())
        cells = np.flatnonzero(total)
        return {"cells": pa.array([packed(cells, total[cells])], pa.binary())}

    def mark(table: pa.Table) -> pa.Table:
        marks = np.zeros(BLOCK_CELLS, bool)
        for cells, less in zip(table.column("cells").to_pylist(), table.column("lacking").to_pylist(), strict=True):
            total = summed([cells])
            marks |= (total > 0) & (total + less >= support)
        return pa.table({"block": table.column("block").slice(0, 1), "bits": [np.packbits(marks, bitorder="little").tobytes()]})

    rows = reports.filter(F.col("block") >= 0).select("lang", "block", "part", "cells")
    rows = added_up(rows, add, "lang string, block int, part bigint, cells binary")
    bits = rows.join(broadcast_when_small(lacking, 256), "lang").groupBy("block").applyInArrow(mark, "block int, bits binary")
    found = Filter.empty()
    for row in bits.collect():
        found.bits[row.block] = np.frombuffer(row.bits, np.uint8)
    return found


def candidates(docs: DataFrame, support: int) -> Filter:
    """The union of what the shards report, length after length."""
    known = Filter.empty()
    for lengths in STEPS:
        known = Filter(known.bits | passed(locally_frequent(docs, support, lengths, known), support).bits)
    return known


COUNTS = "lang string, block int, part bigint, phrases array<string>, counts array<bigint>"


def counted(docs: DataFrame, known: Filter, support: int) -> DataFrame:
    """(lang, phrase, words, a) of every phrase with ``support`` occurrences, and the number of all words as phrase '' of 0 words.

    Every shard reports its counts of all phrases in the filter, as texts, a row per block. What stands in it by chance
    is counted like the others and falls to the same threshold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, part = shared.value, TaskContext.get().partitionId()
        for lang, _, _, shard in shards(batches):
            texts, counts, blocks = [b""], [np.array([len(shard.numbers)])], [np.array([0])]
            for _, digests, n, spelled in shard.mined(seed_of(lang), lambda _, digests, __: union.has(digests), True):
                texts += spelled
                counts.append(n)
                blocks.append(places(digests)[0])
            block = np.concatenate(blocks)
            order = np.argsort(block, kind="stable")
            block = block[order]
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            offsets = pa.array(np.append(starts, len(block)).astype(np.int32))
            phrases = pa.array(texts, pa.binary()).cast(pa.string()).take(pa.array(order))
            columns = [
                pa.array([lang] * len(starts), pa.string()),
                pa.array(block[starts], pa.int32()),
                pa.array([part] * len(starts), pa.int64()),
                pa.ListArray.from_arrays(offsets, phrases),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts)[order], pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "block", "part", "phrases", "counts"])

    def add(table: pa.Table) -> dict[str, pa.Array]:
        flat = {name: table.column(name).combine_chunks().flatten() for name in ("phrases", "counts")}
        sums = pa.table(flat).group_by("phrases").aggregate([("counts", "sum")]).combine_chunks()
        ends = pa.array([0, len(sums)], pa.int32())
        columns = {"phrases": sums.column("phrases"), "counts": sums.column("counts_sum")}
        return {name: pa.ListArray.from_arrays(ends, c.chunk(0) if c.num_chunks else c.combine_chunks()) for name, c in columns.items()}

    found = added_up(written(docs.mapInArrow(run, COUNTS)), add, COUNTS)
    good = F.filter(F.arrays_zip("phrases", "counts"), lambda z: (z["counts"] >= support) | (z["phrases"] == ""))
    rows = found.select("lang", F.explode(good).alias("z")).select("lang", F.col("z.phrases").alias("phrase"), F.col("z.counts").alias("a"))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return rows.select("lang", "phrase", words.alias("words"), "a")


def part(first: str, last: str) -> F.Column:
    """Words ``first`` to ``last`` (from 1) of the phrase."""
    return F.expr(f"array_join(slice(split(phrase, ' ', -1), {first}, {last} - {first} + 1), ' ')")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language.

    Null texts count as empty and a null language as ``und``; ids are not used, so repeated rows count as often as they stand;
    other columns are ignored; an empty table gives no row. Ties go to the more frequent phrase, then to the first in byte
    order. Texts of any length are cut between pieces; one piece is held whole. A phrase inside a longer one with
    as many occurrences is dropped; looking one word further is enough, as every phrase in between has that number too.
    """
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), text_or_empty().alias("text"))
    frequent = written(counted(texts, candidates(texts, support), support))
    totals = frequent.filter(F.col("words") == 0).select("lang", F.col("a").alias("n"))
    phrases = frequent.filter(F.col("words") >= 2)
    inner = phrases.filter(F.col("words") >= 3).select(
        "lang", F.explode(F.array(part("1", "words - 1"), part("2", "words"))).alias("phrase"), F.col("a").alias("around")
    )
    covered = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = phrases.join(covered, ["lang", "phrase"], "left").filter(F.coalesce(F.col("around") < F.col("a"), F.lit(True)))
    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("cut")).select(
        "lang", "phrase", "a", "cut", part("1", "cut").alias("head"), part("cut + 1", "words").alias("tail")
    )
    counts = frequent.filter(F.col("words").between(1, LONGEST - 1))
    known = broadcast_when_small(counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), 400)
    others = broadcast_when_small(counts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), 400)
    scored = (
        cuts.join(known, ["lang", "head"])
        .join(others, ["lang", "tail"])
        .join(broadcast_when_small(totals, 256), "lang")
        .withColumn("score", F.expr("(cast(a AS decimal(16, 0)) * cast(n AS decimal(18, 0)) * 1000BD) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0)))"))
    )
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))
    rows = lowest.select("lang", "phrase", "a", "least.l", "least.r", "n", F.col("least.score").cast("bigint").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        rows.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), parted AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM parted
), grams AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
    FROM starts, (SELECT unnest(range(1, 6)) AS k) AS lengths
    WHERE i + k - 1 <= len(w)
), f AS (
    SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100
), totals AS (
    SELECT lang, sum(len(w)) AS n FROM parted GROUP BY lang
), halves AS (
    SELECT lang, a AS around, k, string_split(phrase, ' ') AS w FROM f WHERE k >= 3
), covered AS (
    SELECT lang, phrase, max(around) AS around
    FROM (SELECT lang, around, array_to_string(w[1 : k - 1], ' ') AS phrase FROM halves
          UNION ALL SELECT lang, around, array_to_string(w[2 : k], ' ') FROM halves)
    GROUP BY lang, phrase
), kept AS (
    SELECT f.lang, f.phrase, f.a, f.k, string_split(f.phrase, ' ') AS w
    FROM f LEFT JOIN covered c ON c.lang = f.lang AND c.phrase = f.phrase
    WHERE f.k >= 2 AND (c.around IS NULL OR c.around < f.a)
), cuts AS (
    SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM kept
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.cut, h.a AS l, t.a AS r, totals.n,
           (1000::HUGEINT * c.a * totals.n) // (h.a::HUGEINT * t.a) AS score
    FROM cuts c
    JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1 : c.cut], ' ')
    JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.cut + 1 : c.k], ' ')
    JOIN totals ON totals.lang = c.lang
), lowest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE place = 1
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""
