"""LM scoring by prediction by partial matching, beside a unigram base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import byte_texts, doc_id, real_id, remainder, text_batches, tie, text_or_empty, written
from cliptide.llm.shingles import rolled, stretches

HELD_OUT_PARTS, HELD_OUT = 7, 2
#: Bytes of the longest context, and the alphabet.
ORDER, SYMBOLS = 5, 256
#: Contexts with their next byte that one pass over the documents scores with; more are scored in more passes.
SHARD_GRAMS = 2_000_000
#: Most frequent words whose counts are sent to all tasks; the counts of the others are joined.
HOT_WORDS = 1 << 18
END = b"\n"
#: Bytes of text that a task works on at once; each takes some sixty bytes of arrays.
BATCH_BYTES = 1 << 19


class Layout:
    """Texts of a batch as one byte array: lower-case words with single spaces and an end mark each.

    A text is preceded by end marks, which stand for the context of its first byte. ``grams`` holds for every byte of
    a text, its end included, the ``ORDER`` bytes before it and itself; ``owner`` its text.
    """

    def __init__(self, texts: list[bytes]):
        bodies = [b" ".join(t.lower().split()) for t in texts]
        sizes = np.array([len(b) + 1 for b in bodies], np.int64)
        self.data = np.frombuffer(b"".join(END * ORDER + b + END for b in bodies), np.uint8)
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        self.symbols = np.arange(len(self.owner)) + ORDER * (self.owner + 1)

    def grams(self) -> np.ndarray:
        g = np.zeros(len(self.symbols), np.uint64)
        for back in range(ORDER, -1, -1):
            g = (g << np.uint64(8)) | self.data[self.symbols - back].astype(np.uint64)
        return g

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every word."""
        inside = (self.data != 0x20) & (self.data != END[0])
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        at = np.searchsorted(self.symbols, starts)
        return self.owner[at], stretches(rolled(self.data), starts, ends).view(np.int64)


def starts_of(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def summed(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at ``starts``."""
    return np.add.reduceat(counts, starts) if len(starts) else np.zeros(0, counts.dtype)


def added(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with the sums of their counts."""
    v, c = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    cuts = starts_of(v)
    return v[cuts], summed(c, cuts)


def counted(docs: DataFrame, what: str, most: int = 500_000) -> DataFrame:
    """(value, n) over all texts of ``docs``: grams or hashes of words, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, held = [], [], 0

        def sent() -> pa.RecordBatch:
            v, c = added(values, counts)
            return pa.RecordBatch.from_arrays([pa.array(v), pa.array(c)], names=["value", "n"])

        for batch in text_batches(batches, BATCH_BYTES):
            layout = Layout(byte_texts(batch))
            v = layout.grams().view(np.int64) if what == "grams" else layout.words()[1]
            v, c = np.unique(v, return_counts=True)
            values.append(v)
            counts.append(c)
            held += len(v)
            if held > most:
                v, c = added(values, counts)
                values, counts, held = [v], [c], len(v)
                if held > most:
                    yield sent()
                    values, counts, held = [], [], 0
        if held:
            yield sent()

    return docs.select("text").mapInArrow(run, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n"))


class Trie:
    """Byte contexts with their counts, as sorted arrays, and the probability of the next byte.

    Method D escapes: a context seen T times with q different next bytes gives one seen c times (c - 1/2) / T and the
    unseen ones q / 2T together. After an escape the bytes of the longer context are excluded from the counts of the shorter one. Below the empty
    context all bytes not excluded are alike.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: np.ndarray):
        """``grams`` are sorted and distinct; ``low`` holds the counts of all pairs of bytes, whose contexts every shard needs whole.

        Levels are built from the longest contexts on, each from the counts of the one before, so that two are held at once.
        """
        self.keys, self.logs, self.contexts, self.plain, self.entered = [], [], [], [], []
        keys, n = grams, counts
        for order in range(ORDER, -1, -1):
            heads = keys >> np.uint64(8)
            cuts = starts_of(heads)
            heads = heads[cuts]
            total, kinds = summed(n, cuts).astype(np.float64), np.diff(np.append(cuts, len(keys))).astype(np.float64)
            self.keys.append(keys)
            self.logs.append(np.log10(n - 0.5).astype(np.float32))
            self.contexts.append(heads)
            self.plain.append((np.log10(total).astype(np.float32), np.log10(0.5 * kinds / total).astype(np.float32)))
            if not order:
                self.entered.append(None)
                self.seen_bytes = len(keys)
                break
            # the shorter contexts, and what they hold without the bytes of these ones
            mask = np.uint64((1 << 8 * order) - 1)
            if order > 2:
                short_keys, short_n = added([keys & mask], [n])
            else:
                table = low if order == 2 else low.sum(0, keepdims=True)
                at = np.flatnonzero(table.ravel())
                short_keys, short_n = at.astype(np.uint64), table.ravel()[at]
            gone = summed(short_n[np.searchsorted(short_keys, keys & mask)], cuts).astype(np.float64)
            short_heads = short_keys >> np.uint64(8)
            starts = starts_of(short_heads)
            sums, widths = summed(short_n, starts).astype(np.float64), np.diff(np.append(starts, len(short_keys))).astype(np.float64)
            own = np.searchsorted(short_heads[starts], heads & (mask >> np.uint64(8)))
            rest, fresh = sums[own] - gone, widths[own] - kinds
            with np.errstate(divide="ignore"):
                # nothing new in the shorter context: it is passed by for free
                self.entered.append((np.where(rest > 0, np.log10(rest), 0).astype(np.float32), np.where(rest > 0, np.log10(0.5 * fresh / np.maximum(rest, 1)), 0).astype(np.float32)))
            keys, n = short_keys, short_n

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each gram after the others."""
        result = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        norm = escape = None  # of the level at hand, if a longer context has been left by an escape
        for level in range(ORDER + 1):
            g = grams[open_] & np.uint64((1 << 8 * (ORDER - level + 1)) - 1)
            heads = g >> np.uint64(8)
            contexts, keys = self.contexts[level], self.keys[level]
            c = np.minimum(np.searchsorted(contexts, heads), max(len(contexts) - 1, 0))
            known = contexts[c] == heads if len(contexts) else np.zeros(len(g), bool)
            k = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
            hit = keys[k] == g if len(keys) else np.zeros(len(g), bool)
            plain_norm, plain_escape = self.plain[level]
            fallen = np.zeros(len(g), bool) if norm is None else ~np.isnan(norm)
            own_norm = np.where(fallen, norm if norm is not None else 0, plain_norm[c] if len(contexts) else 0)
            own_escape = np.where(fallen, escape if escape is not None else 0, np.where(known, plain_escape[c], 0) if len(contexts) else 0)
            result[open_] += np.where(hit, (self.logs[level][k] if len(keys) else 0) - own_norm, own_escape)
            left = ~hit
            if level < ORDER and self.entered[level] is not None and len(contexts):
                n2, e2 = self.entered[level]
                norm = np.where(known, n2[c], np.nan)[left]
                escape = np.where(known, e2[c], np.nan)[left]
            else:
                norm, escape = np.full(left.sum(), np.nan), np.full(left.sum(), np.nan)
            open_ = open_[left]
            if not len(open_):
                return result
        result[open_] -= np.log10(max(SYMBOLS - self.seen_bytes, 1))
        return result

    def score(self, layout: Layout, mine: np.ndarray | None) -> np.ndarray:
        """Summed log10 of each text, over the bytes whose context ends in a pair that ``mine`` marks."""
        grams, owner = layout.grams(), layout.owner
        if mine is not None:
            own = mine[((grams >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]
            grams, owner = grams[own], owner[own]
        order = np.argsort(grams)
        ordered = grams[order]
        cuts = starts_of(ordered)
        logs = np.repeat(self.log10(ordered[cuts]), np.diff(np.append(cuts, len(ordered))))
        return np.bincount(owner[order], weights=logs, minlength=int(layout.owner[-1]) + 1 if len(layout.owner) else 0)


class Shard:
    """A part of the model as it travels: grams with their counts, pairs of bytes, marks of the part's own contexts.

    Its trie is built once in each worker and lives as long as the part that was sent; the grams become its longest level.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: np.ndarray, mine: np.ndarray | None):
        self.grams, self.counts, self.low, self.mine, self.built = grams, counts, low, mine, None

    def trie(self) -> Trie:
        if self.built is None:
            self.built = Trie(self.grams, self.counts, self.low)
            self.counts = None
        return self.built


def shards(grams: DataFrame, most: int = SHARD_GRAMS) -> Iterator[Shard]:
    """Parts of the model of at most ``most`` grams.

    Contexts are parted by their last two bytes, so a context and all shorter ones down to two bytes stand in one
    part; the counts of single bytes and of pairs, 65,536 at most, go with each. Only one part is held at a time.
    """
    pair = F.shiftright("value", 8).bitwiseAND(0xFFFF)
    low = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    for row in grams.groupBy(F.col("value").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect():
        low[row.pair >> 8, row.pair & 0xFF] = row.n
    sizes = {row.pair: row.k for row in grams.groupBy(pair.alias("pair")).agg(F.count("*").alias("k")).collect()}
    parts, part, held = [], [], 0
    for p in sorted(sizes):
        if part and held + sizes[p] > most:
            parts.append(part)
            part, held = [], 0
        part.append(p)
        held += sizes[p]
    parts.append(part)
    for part in parts:
        if len(parts) == 1:
            own, mine = grams, None
        else:
            mine = np.zeros(1 << 16, bool)
            mine[part] = True
            # pairs without counts go with the first part, so that every byte is scored once
            if part is parts[0]:
                mine[[p for p in range(1 << 16) if p not in sizes]] = True
            own = grams.filter(pair.between(part[0], part[-1]))
        table = own.select("value", "n").toArrow()
        values, counts = table.column("value").to_numpy().view(np.uint64), table.column("n").to_numpy()
        order = np.argsort(values)
        yield Shard(values[order], counts[order], low, mine)


SUMMARY = "row bigint, id bigint, tie bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, word bigint, times bigint"


def passed(docs: DataFrame, shard, hot, ends: int, with_words: bool) -> DataFrame:
    """One pass over (id, tie, held_out, text): a summary row per text, and a row per word that is not hot.

    Rows are numbered while they are written; ``word`` is null in a summary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, mine = shard.value.trie(), shard.value.mine
        hot_words, hot_counts = hot.value
        at = TaskContext.get().partitionId() << 40
        for batch in text_batches(batches, BATCH_BYTES):
            layout = Layout(byte_texts(batch))
            n = batch.num_rows
            rows = np.arange(at, at + n)
            at += n
            score = trie.score(layout, mine)
            tokens, known, base = np.ones(n, np.int64), np.full(n, int(ends > 0)), np.full(n, np.log10(ends + 1.0))
            cold_rows = cold_words = cold_times = np.zeros(0, np.int64)
            if with_words:
                owner, words = layout.words()
                tokens += np.bincount(owner, minlength=n)
                distinct, back = np.unique(words, return_inverse=True)
                place = np.minimum(np.searchsorted(hot_words, distinct), max(len(hot_words) - 1, 0))
                is_hot = (hot_words[place] == distinct if len(hot_words) else np.zeros(len(distinct), bool))[back]
                known = known + np.bincount(owner[is_hot], minlength=n)
                if len(hot_words):
                    logs = np.log10(hot_counts[place] + 1.0)[back]
                    base = base + np.bincount(owner[is_hot], weights=logs[is_hot], minlength=n)
                cold = np.flatnonzero(~is_hot)
                pairs, cold_times = np.unique(owner[cold].astype(np.int64) * len(distinct) + back[cold], return_counts=True) if len(cold) else (np.zeros(0, np.int64), cold_times)
                cold_rows, cold_words = rows[pairs // max(len(distinct), 1)], distinct[pairs % max(len(distinct), 1)]
            m = len(cold_rows)
            none = [pa.nulls(m, k) for k in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            head = [batch.column(0), batch.column(1), batch.column(2), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)]
            columns = [pa.concat_arrays([pa.array(rows), pa.array(cold_rows)])]
            columns += [pa.concat_arrays([h, x]) for h, x in zip(head, none, strict=True)]
            columns += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(c, pa.int64())]) for c in (cold_words, cold_times)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SUMMARY.split(", ")])

    return written(docs.mapInArrow(run, SUMMARY))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of (doc_id, text).

    Texts are lower-cased in ASCII; tokens are the words and one end. Documents whose crc32 remainder is not
    ``HELD_OUT`` are learned from, null ids with them. ``base_score`` adds log10((c + 1) / (N + V + 1)) over the tokens.
    ``score`` is log10 of the probability of the text, read as its words with single spaces and an end, under a byte trie of
    order ``ORDER`` that counts every byte of all training texts; scoring changes no counts. Null and empty texts are
    one end. Repeated rows are documents of their own. Where nothing can be learned from, all bytes are alike.

    Counts of words beyond the ``HOT_WORDS`` most frequent are joined, not broadcast: texts send one row for each
    of their rare words. The trie goes out in parts of ``SHARD_GRAMS``, each with a pass over the documents.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(remainder(HELD_OUT_PARTS) == HELD_OUT, F.lit(False))
    texts = docs.select(doc_id().alias("id"), tie().alias("tie"), held_out.alias("held_out"), text_or_empty().alias("text"))
    training = texts.filter(~F.col("held_out"))
    grams = written(counted(training, "grams"))
    words = written(counted(training, "words"))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    n_train, floor = totals.n + ends, totals.n + ends + totals.v + int(ends > 0) + 1
    table = words.orderBy(F.desc("n"), "value").limit(HOT_WORDS).toArrow().sort_by("value")  # at most HOT_WORDS rows
    hot = spark.sparkContext.broadcast((table.column("value").to_numpy(), table.column("n").to_numpy()))

    first, others = None, []
    for shard in shards(grams):
        sent = spark.sparkContext.broadcast(shard)  # at most SHARD_GRAMS grams
        part = passed(texts, sent, hot, ends, first is None)
        if first is None:
            first = part
        else:
            others.append(part.filter("word is null").select("id", "tie", F.col("score").alias(f"score{len(others)}")).dropDuplicates(["id", "tie"]))
        sent.unpersist()
    cold = first.filter("word is not null").select("row", F.col("word").alias("value"), "times")
    met = cold.join(words, "value").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("cold"), F.sum("times").alias("cold_known")
    )
    rows = first.filter("word is null").join(met, "row", "left")
    total = F.col("score")
    for k, other in enumerate(others):
        rows = rows.join(other, ["id", "tie"])
        total = total + F.col(f"score{k}")
    base = F.col("base") + F.coalesce("cold", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(float(floor))))
    return rows.select(
        real_id().alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_train)).cast("bigint").alias("train_tokens"), base.alias("base_score"), total.alias("score"),
    )
