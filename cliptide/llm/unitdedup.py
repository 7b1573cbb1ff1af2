"""Substring dedup by unit hashing: lines, and the sentences of longer lines, keep their earliest occurrence."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import doc_id, keyed, real_id, text_batches, tie, written

#: Fewest words of a line, and of a sentence inside a line, that count as a unit.
LINE_WORDS, SENTENCE_WORDS = 3, 5

SENTENCE_END = re.compile(r"(?<=[.!?…])[ \t]+")


def units(text: str) -> list[tuple[int, int, bytes]]:
    """(start, end, normal form) of every unit; offsets count characters, a unit takes the white space after it.

    The whole line is a unit and so is each sentence of a line that has several. Normal form: A-Z in
    lower case, words parted by one space, sentence marks at the end dropped.
    """
    found, at = [], 0
    for line in text.split("\n"):
        stop = min(at + len(line) + 1, len(text))
        words = line.encode("utf-8", "replace").lower().split()
        if len(words) >= LINE_WORDS:
            found.append((at, stop, b" ".join(words).rstrip(b".!?")))
            cuts = [at, *(at + m.end() for m in SENTENCE_END.finditer(line)), stop]
            if len(cuts) > 2:
                for a, b in pairwise(cuts):
                    words = text[a:b].encode("utf-8", "replace").lower().split()
                    if len(words) >= SENTENCE_WORDS:
                        found.append((a, b, b" ".join(words).rstrip(b".!?")))
        at = stop
    return found


UNITS = "id bigint, tie bigint, start int, stop int, h1 bigint, h2 bigint"


def unit_rows(docs: DataFrame) -> DataFrame:
    """One row per unit of (id, tie, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            owner, starts, stops, digests = [], [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for a, b, form in units(text):
                    owner.append(row)
                    starts.append(a)
                    stops.append(b)
                    digests.append(hashlib.blake2b(form, digest_size=16).digest())
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            rows = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()),
                 pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=["id", "tie", "start", "stop", "h1", "h2"],
            )

    return docs.mapInArrow(run, UNITS)


def removed_spans(docs: DataFrame) -> DataFrame:
    """(id, tie, spans) of documents that lose units; spans are (start, stop) of later occurrences.

    Digests are counted first, with a map-side sum, so that a unit that very many documents share is one
    row; only units with a shared digest go on. The join on the digest may be split for hot digests.
    """
    keys = ["h1", "h2"]
    shared = unit_rows(keyed(docs)).groupBy(*keys).count().filter("count > 1").select(*keys)
    repeated = written(unit_rows(keyed(docs)).join(shared, keys))
    place = F.struct("id", "tie", "start")
    first = repeated.groupBy(*keys).agg(F.min(place).alias("first"))
    later = repeated.join(first, keys).filter(place != F.col("first"))
    return later.groupBy("id", "tie").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))


RESULT = "doc_id bigint, n_units bigint, n_removed bigint, n_chars_removed bigint, spans array<struct<start:int,stop:int>>, kept string"


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_units, n_removed, n_chars_removed, spans, kept) of each row of ``docs``.

    Units are lines of at least ``LINE_WORDS`` words and sentences of at least ``SENTENCE_WORDS`` words
    inside longer lines. Of equal units the one with the smallest (id, text digest, start) stays; the others
    are cut out. ``spans`` are the removed stretches in characters of the original text, joined where they touch.
    Null texts count as empty and are kept as empty; rows with equal id and text are one document and get the same
    result; null ids rank first. The only groups are the units of one document.
    """
    spans = removed_spans(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            out = []
            for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in cut or ():
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["stop"])
                    else:
                        merged.append([s["start"], s["stop"]])
                kept = "".join(text[a:b] for a, b in zip([0, *(m[1] for m in merged)], [*(m[0] for m in merged), len(text)], strict=True))
                out.append((len(units(text)), len(cut or ()), len(text) - len(kept), [{"start": a, "stop": b} for a, b in merged], kept))
            columns = list(zip(*out, strict=True))
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            kinds = [pa.int64()] * 3 + [span, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "n_units", "n_removed", "n_chars_removed", "spans", "kept"],
            )

    rows = docs.select(doc_id().alias("id"), tie().alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.join(spans, ["id", "tie"], "left").select("id", "text", "spans")
    return joined.mapInArrow(run, RESULT).withColumn("doc_id", real_id("doc_id"))
