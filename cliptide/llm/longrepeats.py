"""Removal of long repeated byte strings: a run-length index over shared places and streamed matching statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cliptide.llm.common import byte_texts, doc_id, in_cells, keyed, marked_cells, real_id, text_batches, text_or_empty, tie, where_marked, written
from cliptide.llm.rlindex import RunIndex
from cliptide.llm.shingles import gram_hashes, rolled, stretches
from cliptide.session import BROADCAST_LIMIT_BYTES, broadcast_when_small

#: Bytes of a string that may not repeat, and of the grams whose smallest hash anchors a string.
LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1
#: A string reaches so far beyond its anchor on one side at least.
REACH = -(-(LENGTH - GRAM) // 2)
#: Strings that start within so many bytes have their other bytes in common: a core, told by where it starts.
STEP = 10
CORES = (LENGTH - GRAM) // STEP + 1
#: Index strings per index, and streamed strings that share an anchor before they are parted.
GROUP_STRINGS, HOT = 4000, 2000
BATCH_BYTES = 1 << 20
#: Strings whose anchors are looked for at once, and the bits of a key that tell a gram's place among them.
BLOCK, PLACE = 1 << 15, np.uint64(0xFFFF)
ORDER = np.arange(BLOCK + SPAN - 1, dtype=np.uint64)
NONE = bytes(16)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every stretch of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchor_runs(data: np.ndarray, sums: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where strings of ``LENGTH`` bytes start that have another anchor than the one before or begin a text, and their anchors' places.

    Works on blocks of ``BLOCK`` strings, whose arrays stay in a core's cache. A gram's place in its block takes the lowest
    bits of its hash, so one minimum gives the leftmost gram of smallest hash, told by the other 48 bits.
    """
    count = len(data) - LENGTH + 1
    opens, places, before = [], [], -1
    for low in range(0, count, BLOCK):
        strings = min(BLOCK, count - low)
        keys = gram_hashes(sums, low, low + strings + SPAN - 1, GRAM)
        keys &= ~PLACE
        keys |= ORDER[: len(keys)]
        least = sliding(keys, SPAN, np.minimum)
        changes = np.empty(strings, bool)
        changes[0] = int(least[0] & PLACE) + low != before
        np.not_equal(least[1:], least[:-1], out=changes[1:])
        changes[begins[np.searchsorted(begins, low) : np.searchsorted(begins, low + strings)] - low] = True
        found = np.flatnonzero(changes)
        opens.append(found + low)
        places.append((least[found] & PLACE).astype(np.int64) + low)
        before = int(least[-1] & PLACE) + low
    return np.concatenate(opens), np.concatenate(places)


class Anchored:
    """Texts of a batch with their strings of ``LENGTH`` bytes, each anchored at its leftmost gram of smallest hash.

    Strings that follow each other with the same anchor make one stretch: ``owner`` is its text, ``low`` to ``high``
    are where its strings start (in the text), ``anchor`` hashes the gram and ``body`` all its bytes and the anchor's place.
    ``left`` and ``right`` hash the gram with the ``REACH`` bytes on one side, 0 where the stretch does not go so far: two
    stretches that share a string share one of them. With ``cells`` only stretches whose anchor is in a marked one are
    taken; ``bare`` ones have no ``body``, ``left`` and ``right``.
    """

    def __init__(self, texts: list[bytes], cells: np.ndarray | None = None, bare: bool = False):
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not (sizes >= LENGTH).any():
            self.owner = self.low = self.high = self.rel = self.anchor = self.body = self.left = self.right = np.zeros(0, np.int64)
            return
        sums = rolled(data)
        first, place = anchor_runs(data, sums, begins)
        last = np.append(first[1:], len(data) - LENGTH + 1) - 1
        # strings that reach from one text into the next are none
        owner = np.searchsorted(begins, first, side="right") - 1
        final = (begins + sizes - LENGTH)[owner]
        inside = np.flatnonzero(first <= final)
        anchor = stretches(sums, place[inside], place[inside] + GRAM).view(np.int64)
        if cells is not None:
            marked = in_cells(cells, anchor)
            inside, anchor = inside[marked], anchor[marked]
        self.owner, self.anchor = owner[inside], anchor
        first, last, place = first[inside], np.minimum(last, final)[inside], place[inside]
        self.low, self.high = first - begins[self.owner], last - begins[self.owner]
        self.rel = place - first
        if bare:
            return
        begin, end = np.maximum(place - REACH, 0), np.minimum(place + GRAM + REACH, len(data))
        self.left = np.where(place - REACH >= first, stretches(sums, begin, place + GRAM) | np.uint64(1), np.uint64(0)).view(np.int64)
        self.right = np.where(place + GRAM + REACH <= last + LENGTH, stretches(sums, place, end) | np.uint64(1), np.uint64(0)).view(np.int64)
        whole = stretches(sums, first, last + LENGTH)
        self.body = (whole + self.rel.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def later(self, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether an equal stretch stands earlier in the batch, by id and tie of the texts and place."""
        _, rank = np.unique(np.stack([ids, ties]), axis=1, return_inverse=True)
        rank = rank.ravel()[self.owner]
        order = np.lexsort((self.low, rank, self.anchor, self.body))
        anchor, body, low, rank = self.anchor[order], self.body[order], self.low[order], rank[order]
        opens = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (body[1:] != body[:-1])])[: len(order)]
        first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        found = np.empty(len(order), bool)
        found[order] = (rank != rank[first]) | (low != low[first])
        return found


STRETCH = "id bigint, tie bigint, low int, high int, rel int, anchor bigint, body bigint, left int, right int, salt int"


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, n): the anchors of the texts' stretches, those of a batch counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, BATCH_BYTES):
            found, n = np.unique(Anchored(byte_texts(batch), bare=True).anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor bigint, n bigint")


def anchored(docs: DataFrame, cells: np.ndarray) -> DataFrame:
    """The stretches of (id, tie, text) whose anchor is in a marked one of ``cells``.

    ``salt`` is 0 for the first of equal stretches of a batch, and spreads the others, which are not the first of all.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, BATCH_BYTES):
            a = Anchored(byte_texts(batch), shipped.value)
            at, salt = pa.array(a.owner), np.zeros(len(a.owner), np.int32)
            later = a.later(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            salt[later] = 1 + np.arange(np.count_nonzero(later))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), batch.column(1).take(at),
                    *[pa.array(x.astype(np.int32)) for x in (a.low, a.high, a.rel)],
                    *[pa.array(x) for x in (a.anchor, a.body)],
                    # only to tell stretches that cannot share a string, so half of the hash will do
                    *[pa.array((x >> 32).astype(np.int32)) for x in (a.left, a.right)],
                    pa.array(salt),
                ],
                names=["id", "tie", "low", "high", "rel", "anchor", "body", "left", "right", "salt"],
            )

    return docs.mapInArrow(run, STRETCH)


def table_bytes(rows: DataFrame, pieces: str) -> int:
    """What (id, tie, ``pieces``), an array of structs of up to four numbers, takes while it is broadcast."""
    return rows.agg(F.sum(F.lit(100) + 48 * F.size(pieces))).first()[0] or 0


def with_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hash", F.xxhash64("id", "tie"))


def cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (id, tie, low, high, rel, anchor) with their ``bytes``."""
    columns = ["low", "high", "rel", "anchor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows, out, pieces = [], {c: [] for c in columns}, []
            for k, (text, own) in enumerate(zip(byte_texts(batch), batch.column(3).to_pylist(), strict=True)):
                for w in own:
                    rows.append(k)
                    pieces.append(text[w["low"] : w["high"] + LENGTH])
                    for c in columns:
                        out[c].append(w[c])
            at = pa.array(rows, pa.int64())
            kinds = [pa.int32()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(out[c], k) for c, k in zip(columns, kinds, strict=True)], pa.array(pieces, pa.binary())],
                names=["id", "tie", *columns, "bytes"],
            )

    per_doc = written(wanted.groupBy("id", "tie").agg(F.collect_list(F.struct(*columns)).alias("own")))
    rows = keyed(docs)
    if table_bytes(per_doc, "own") <= BROADCAST_LIMIT_BYTES:
        per_doc = F.broadcast(per_doc)
    else:
        rows = with_hash(rows)
        rows = where_marked(rows, "hash", marked_cells(with_hash(per_doc), "hash"), True)
    rows = rows.join(per_doc, ["id", "tie"]).select("id", "tie", "text", "own")
    return rows.mapInArrow(run, "id bigint, tie bigint, low int, high int, rel int, anchor bigint, bytes binary")


def rivals(strings: DataFrame) -> DataFrame:
    """The strings that share a core with another one, with ``cores``, a bit for each shared one, and their anchor's ``rivals`` and first.

    All strings of ``LENGTH`` bytes that start up to ``STEP`` bytes before a core hold it, so what has no
    core in common has no such string in common.
    """
    at = F.col("rel") - STEP * F.col("k")
    cores = (
        strings.select("id", "tie", "low", "rel", "anchor", "bytes", F.explode(F.sequence(F.lit(0), F.lit(CORES - 1))).alias("k"))
        .filter((at >= 0) & (at + LENGTH - STEP <= F.octet_length("bytes")))
        .select("id", "tie", "low", "anchor", "k", F.xxhash64(F.col("bytes").substr(at + 1, F.lit(LENGTH - STEP))).alias("core"))
    )
    shared = cores.withColumn("n", F.count("*").over(Window.partitionBy("anchor", "k", "core"))).filter("n > 1")
    marks = shared.groupBy("id", "tie", "low").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("cores"))
    chosen = strings.join(broadcast_when_small(written(marks), 40), ["id", "tie", "low"])
    leads = chosen.groupBy("anchor").agg(F.count("*").alias("rivals"), F.min(F.struct("id", "tie", "low")).alias("lead")).filter("rivals > 1")
    return chosen.join(leads, "anchor").withColumn("indexed", F.struct("id", "tie", "low") == F.col("lead")).drop("lead")


def streamed(strings: DataFrame) -> DataFrame:
    """Matching statistics of the strings that are not indexed against the first string of each anchor.

    Gives (id, tie, start, stop) of stretches that the index holds, and (id, tie, start, stop, h1, h2) of each
    string of ``LENGTH`` bytes that it does not hold but that has a shared core.
    The first string of an anchor that very many share is indexed in several groups, and the others are dealt to them.
    """

    def run(key, table):
        indexed = table.column("indexed").to_numpy()
        pieces = table.column("bytes").to_pylist()
        ids, ties, low, high, rel, cores = (table.column(c).to_numpy() for c in ("id", "tie", "low", "high", "rel", "cores"))
        index = RunIndex([pieces[k] for k in np.flatnonzero(indexed)])
        lanes = np.flatnonzero(~indexed)
        owner, starts, stops, digests = [lanes[:0]], [lanes[:0]], [lanes[:0]], []
        for part in np.array_split(lanes, -(-len(lanes) // 4096)) if len(lanes) else ():
            counts = high[part] - low[part] + 1
            lengths = index.matching_statistics([pieces[k] for k in part], LENGTH)
            held = np.concatenate([found[:n] for found, n in zip(lengths, counts, strict=True)]) == LENGTH
            of, ends = np.repeat(part, counts), np.cumsum(counts)
            place = np.arange(len(of)) - np.repeat(ends - counts, counts)
            turns = held[1:] != held[:-1]
            turns[ends[:-1] - 1] = True
            begins = np.flatnonzero(np.append(True, turns) & held)
            stays = np.flatnonzero(np.append(turns, True) & held)
            open_ = np.flatnonzero(~held & ((cores[of] >> ((rel[of] - place) // STEP)) & 1).astype(bool))
            owner += [of[begins], of[open_]]
            starts += [low[of[begins]] + place[begins], low[of[open_]] + place[open_]]
            stops += [low[of[begins]] + place[stays] + LENGTH, low[of[open_]] + place[open_] + LENGTH]
            digests += [NONE] * len(begins)
            digests += [hashlib.blake2b(pieces[k][s : s + LENGTH], digest_size=16).digest() for k, s in zip(of[open_].tolist(), place[open_].tolist(), strict=True)]
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        mask = np.array([d is NONE for d in digests], bool)
        at, start, stop = (np.concatenate(x) for x in (owner, starts, stops))
        return pa.table(
            {"id": pa.array(ids[at]), "tie": pa.array(ties[at]), "start": pa.array(start.astype(np.int32)), "stop": pa.array(stop.astype(np.int32))}
            | {f"h{k + 1}": pa.array(np.ascontiguousarray(halves[:, k]), mask=mask) for k in (0, 1)}
        )

    salts = F.ceil(F.col("rivals") / HOT).cast("int")
    dealt = strings.withColumn("salts", salts).withColumn(
        "salt", F.explode(F.when(F.col("indexed"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "tie", "low"), "salts").cast("int"))))
    )
    groups = max(1, strings.filter("indexed").count() // GROUP_STRINGS + 1)
    rows = dealt.withColumn("deal", F.pmod(F.xxhash64("anchor", "salt"), F.lit(groups)))
    return rows.groupBy("deal").applyInArrow(run, "id bigint, tie bigint, start int, stop int, h1 bigint, h2 bigint")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, tie, start, stop): stretches of bytes covered by strings that also start earlier.

    A string of ``LENGTH`` bytes is anchored by its own bytes alone, so all its occurrences share an anchor, and
    most text has anchors of its own and leaves at the first count. Equal stretches are told by their digest; the
    earliest is their first. Stretches that differ under one anchor go to the index: the earliest is indexed, the
    others are streamed. What the index does not hold can only repeat among the streamed ones and is
    counted by digest. No group but a set of index strings is ever gathered.
    """
    texts = keyed(docs)
    shared = written(anchors(texts).groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"))
    # an anchor that only shares a cell has one variant and goes with the other single ones
    places = anchored(texts, marked_cells(shared, "anchor"))
    # rows of one document that stands twice are equal in place: none of them is later than the other
    by_place = Window.partitionBy("anchor", "body", "salt").orderBy("id", "tie", "low")
    marks = {"first": (F.col("salt") == 0) & (F.row_number().over(by_place) == 1), "again": (F.col("salt") > 0) | (F.rank().over(by_place) > 1)}
    ranked = written(places.withColumns(marks).drop("salt"))
    later = ranked.filter("again").select("id", "tie", F.col("low").alias("start"), (F.col("high") + LENGTH).alias("stop"))
    # stretches that agree with another one far enough on one side; the rest share no string with another
    variants = ranked.filter("first").select("id", "tie", "low", "high", "rel", "anchor", "left", "right").repartition("anchor")
    agree = {side: F.col(side).isNotNull() & (F.col(side) != 0) & (F.count("*").over(Window.partitionBy("anchor", side)) > 1) for side in ("left", "right")}
    alike = variants.withColumns({f"{side}_agrees": c for side, c in agree.items()}).filter("left_agrees or right_agrees")
    several = alike.withColumn("k", F.count("*").over(Window.partitionBy("anchor"))).filter("k > 1")
    strings = cut_out(docs, several.select("id", "tie", "low", "high", "rel", "anchor"))
    if not texts.groupBy("id", "tie").count().filter("count > 1").isEmpty():
        strings = strings.dropDuplicates(["id", "tie", "low"])
    found = written(streamed(written(rivals(written(strings)))))
    by_start = Window.partitionBy("h1", "h2").orderBy("id", "tie", "start")
    again = found.filter("h1 is not null").withColumn("again", F.rank().over(by_start) > 1).filter("again").select("id", "tie", "start", "stop")
    return later.unionByName(found.filter("h1 is null").select("id", "tie", "start", "stop")).unionByName(again)


def joined_spans(spans: DataFrame) -> DataFrame:
    """(id, tie, spans): the stretches of each document, joined where they touch, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            values = lists.flatten().to_numpy()
            base = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()) << 32
            start, stop = base + (values >> 32), np.maximum.accumulate(base + (values & 0xFFFFFFFF))
            opens = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
            ends = stop[np.append(opens[1:], len(stop)) - 1] & 0xFFFFFFFF
            offsets = np.searchsorted(base[opens], np.arange(batch.num_rows + 1) << 32).astype(np.int32)
            pieces = pa.StructArray.from_arrays(
                [pa.array((start[opens] & 0xFFFFFFFF).astype(np.int32)), pa.array(ends.astype(np.int32))], names=["start", "stop"]
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pieces)], names=["id", "tie", "spans"])

    packed = F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("stop")
    lists = spans.groupBy("id", "tie").agg(F.sort_array(F.collect_set(packed)).alias("spans"))
    return lists.mapInArrow(run, "id bigint, tie bigint, spans array<struct<start:int,stop:int>>")


RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:int,stop:int>>, kept_sha256 string"


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256) of each row of ``docs``, in UTF-8 bytes.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a smaller id
    (then text digest), or before in the same one. ``spans`` are the removed stretches, joined where they touch. Null texts
    count as empty; rows with equal id and text are one document and get the same result; null ids rank first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            out = []
            for text, spans in zip(byte_texts(batch), batch.column(2).to_pylist(), strict=True):
                merged = [(s["start"], s["stop"]) for s in spans or ()]
                left = [text[a:b] for a, b in zip([0, *(m[1] for m in merged)], [*(m[0] for m in merged), len(text)], strict=True)]
                digest = hashlib.sha256(b"".join(left)).hexdigest()
                out.append((len(text), sum(b - a for a, b in merged), len(merged), [{"start": a, "stop": b} for a, b in merged], digest))
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            kinds = [pa.int64()] * 3 + [span, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]],
                names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"],
            )

    spans = written(joined_spans(repeated_spans(docs)))
    rows = docs.select(doc_id().alias("id"), tie().alias("tie"), text_or_empty().alias("text"))
    if table_bytes(spans, "spans") <= BROADCAST_LIMIT_BYTES:
        joined = rows.join(F.broadcast(spans), ["id", "tie"], "left").select("id", "text", "spans")
    else:
        # texts without spans stay where they are read
        rows, cells = with_hash(rows), marked_cells(with_hash(spans), "hash")
        joined = where_marked(rows, "hash", cells, True).join(spans, ["id", "tie"], "left").select("id", "text", "spans")
        bare = where_marked(rows, "hash", cells, False)
        joined = joined.unionByName(bare.select("id", "text", F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans")))
    return joined.mapInArrow(run, RESULT).select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256")
