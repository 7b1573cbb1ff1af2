"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import byte_texts, components, doc_id, keyed, marked_cells, real_id, text_batches, tie, where_marked, written
from cliptide.llm.shingles import shingle_set
from cliptide.session import broadcast_when_small

#: Similarity as a fraction of whole numbers: intersection * DOWN >= union * UP.
UP, DOWN = 80, 100
#: Counters of the frequency estimate (fixed size, whatever the corpus), and the parts they are summed in.
BUCKETS, PARTS = 1 << 22, 64
#: Every prefix is longer than the shortest one by this many hundredths of its set, and by at most so many tokens more.
LONGER, LONGEST = 3, 8
#: Tokens of buckets from this class on are common; they are not looked up one by one.
COMMON = 40
#: Rows of a posting list that one task compares with as many others.
BLOCK = 512
#: Sets whose sizes differ by less than this factor wait in one place of a list.
CELL = 1.05
#: Posting rows that are compared in one call.
GROUP_ROWS = 20_000
#: Bytes that a row of a few numbers takes at most while a broadcast is built: collected, hashed and serialised.
ROW_BYTES = 200
#: Largest table that is broadcast for a join of narrow rows; a shuffle of those costs little.
NARROW_LIMIT = 4 << 20


def required(n: int) -> int:
    """Fewest tokens that a set of ``n`` shares with a similar one."""
    return -(-UP * n // DOWN)


def least_matches(n: int) -> int:
    """Tokens that the prefixes of two similar sets share at least, if neither has fewer than ``n``."""
    return 1 + n * LONGER // 100


def frequency_classes(docs: DataFrame) -> np.ndarray:
    """Class of each bucket: eighths of a doubling of its count over the mean, 0 up to the mean.

    All shingles of all documents are counted. Each task adds up its own counters and sends them on in
    ``PARTS`` pieces, so the driver gets ``BUCKETS`` numbers however large the corpus is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in text_batches(batches):
            hashes = [shingle_set(t) for t in byte_texts(batch)]
            if hashes:
                total += np.bincount((np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        if total.any():
            pieces = total.reshape(PARTS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PARTS), pa.int32()), pa.array([packed(p) for p in pieces], pa.binary())],
                names=["part", "counts"],
            )

    def add(key, rows):
        total = np.zeros(BUCKETS // PARTS, np.int64)
        for piece in rows.column("counts").to_pylist():
            total += np.frombuffer(piece, f"u{len(piece) // len(total)}").astype(np.int64)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([packed(total)], pa.binary())})

    pieces = docs.select("text").mapInArrow(count, "part int, counts binary")
    summed = pieces.groupBy("part").applyInArrow(add, "part int, counts binary").collect()  # PARTS rows
    each = BUCKETS // PARTS
    counts = {row.part: np.frombuffer(row.counts, f"u{len(row.counts) // each}") for row in summed}
    mean = max(sum(int(c.sum(dtype=np.int64)) for c in counts.values()) / BUCKETS, 1.0)
    classes = np.zeros((PARTS, each), np.uint8)
    for part, c in counts.items():
        classes[part] = np.clip(8 * np.log2(np.maximum(c / mean, 1.0)), 0, 255)
    return classes.ravel()


def packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def classed(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return classes[(tokens % np.uint64(BUCKETS)).astype(np.int64)]


def prefix(tokens: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(prefix, matches, last): the tokens that stand first when rare ones come first, how many must be shared,
    and the place of the last of them in the order of all tokens.

    ``matches`` grows with the set and with the estimated number of candidates that the shortest prefix would
    meet, one for each doubling, and the prefix by the same number of tokens.
    """
    n = len(tokens)
    kinds = classed(tokens, classes)
    order = np.lexsort((tokens, kinds))
    base = n - required(n) + 1
    # a bucket of class c holds about 2**(c/8) times the mean; what is above the mean is met
    met = float(np.sum(np.exp2(kinds[order[:base]] / 8.0) - 1.0))
    matches = min(least_matches(n) + min(LONGEST - 1, int(np.log2(1.0 + met))), n - base + 1)
    end = order[base + matches - 2]
    return tokens[order[: base + matches - 1]], matches, int(kinds[end]) << 55 | int(tokens[end]) >> 9


def signatures(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """(row, id, tie, n, d1, d2, matches, last, prefix) of (id, tie, text).

    d1 and d2 are a digest of the whole set; rows are numbered as they are written.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(classes)  # BUCKETS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in text_batches(batches):
            out = []
            rows = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            for t in byte_texts(batch):
                tokens = shingle_set(t)
                d = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)
                first, matches, last = prefix(tokens, shipped.value) if len(tokens) else (tokens, 0, 0)
                out.append((len(tokens), int(d[0]), int(d[1]), matches, last, first.tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]],
                names=["row", "id", "tie", "n", "d1", "d2", "matches", "last", "prefix"],
            )

    return written(docs.mapInArrow(run, "row bigint, id bigint, tie bigint, n bigint, d1 bigint, d2 bigint, matches int, last bigint, prefix binary"))


def postings(signed: DataFrame, classes: np.ndarray) -> DataFrame:
    """(token, node) for the prefix tokens that more than one node holds, as far as can be told.

    Rows are dealt by token and sorted, and neighbours compared as they stream by; no list is gathered. Common tokens
    would crowd one task, and are shared anyway: they pass by.
    """
    shipped = signed.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            lists = [np.frombuffer(p, np.uint64) for p in batch.column(1).to_pylist()]
            if lists:
                tokens = np.concatenate(lists)
                common = classed(tokens, shipped.value) >= COMMON
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens.view(np.int64)), pa.array(np.repeat(nodes, [len(p) for p in lists])), pa.array(common)], names=["token", "node", "common"]
                )

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, node, met = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last row waits for the next batch; ``met`` tells whether it had an equal before it
            token = np.concatenate([token, batch.column(0).to_numpy()])
            node = np.concatenate([node, batch.column(1).to_numpy()])
            equal = token[1:] == token[:-1]
            keep = np.concatenate([[met], equal]) | np.concatenate([equal, [False]])
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(node[keep])], names=["token", "node"])
            met = bool(equal[-1]) if len(equal) else met
            token, node = token[-1:], node[-1:]
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node)], names=["token", "node"])

    rows = signed.select("node", "prefix").mapInArrow(run, "token bigint, node bigint, common boolean")
    dealt = rows.filter("not common").select("token", "node").repartition("token").sortWithinPartitions("token")
    return dealt.mapInArrow(shared, "token bigint, node bigint").unionByName(rows.filter("common").select("token", "node"))


def marked(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose columns are among the keys, and a few others: keys travel as bits, and no row is shuffled."""
    key = F.xxhash64(*columns).alias("key")
    bits = marked_cells(keys.select(key), "key")
    return where_marked(rows.select("*", key), "key", bits, inside=True).drop("key")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tokens) of the wanted (id, tie, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingle_set(t).tobytes() for t in byte_texts(batch)], pa.binary())], names=["node", "tokens"]
            )

    rows = keyed(docs).join(broadcast_when_small(wanted, ROW_BYTES), ["id", "tie"]).select("node", "text")
    return rows.mapInArrow(run, "node bigint, tokens binary")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose sets are similar enough; both sets are compared whole.

    Each set travels to a pair by a join on its node, which is split where one node has very many pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DOWN * both >= UP * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["src", "dst"])

    far = sets.select(F.col("node").alias("dst"), F.col("tokens").alias("y"))
    near = sets.select(F.col("node").alias("src"), F.col("tokens").alias("x"))
    joined = pairs.join(far, "dst").join(near, "src").select("src", "dst", "x", "y")
    return joined.mapInArrow(run, "src bigint, dst bigint")


def possible(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs (src, dst) that their prefixes leave possible: enough shared tokens, and the rest could make up the overlap."""
    kept = F.struct("n", "matches", "last", (F.col("n") - F.col("length")).alias("rest"))
    a = info.select(F.col("node").alias("src"), kept.alias("a"), F.col("tokens").alias("ta"))
    b = info.select(F.col("node").alias("dst"), kept.alias("b"), F.col("tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    # shared tokens up to the end of the prefix that ends first stand in both prefixes, later ones in the rest of that set
    rest = (
        F.when(F.col("a.last") < F.col("b.last"), F.col("a.rest"))
        .when(F.col("a.last") > F.col("b.last"), F.col("b.rest"))
        .otherwise(F.greatest("a.rest", "b.rest"))
    )
    enough = (shared >= F.least("a.matches", "b.matches")) & ((DOWN + UP) * (shared + rest) >= UP * (F.col("a.n") + F.col("b.n")))
    # sizes alone rule out most pairs, before the tokens travel
    sizes = broadcast_when_small(info.select("node", "n"), ROW_BYTES, NARROW_LIMIT)
    near = pairs.join(sizes.withColumnsRenamed({"node": "src", "n": "ns"}), "src").join(sizes.withColumnsRenamed({"node": "dst", "n": "nd"}), "dst")
    near = near.filter(DOWN * F.least("ns", "nd") >= UP * F.greatest("ns", "nd")).select("src", "dst")
    return near.join(a, "src").join(b, "dst").filter(enough).select("src", "dst")


def candidates(info: DataFrame) -> DataFrame:
    """Pairs of nodes in different groups that may be similar; a pair may come from several posting lists.

    ``info`` holds (node, group, n, matches, length, last, tokens): the shared tokens of the node's prefix, rarest list
    first. A pair is met at the first token that both prefixes hold, so from the list of a token on only the tokens
    behind it can be shared as well: they alone travel to that list, and the last ones, behind which too few stand, are
    in no list. In every list a set waits at its own size and asks at the sizes of smaller sets. Which sizes those can be
    follows from the prefix that ends first: what it shares, and the rest of its set, must make up the overlap. Places
    with one group have nothing to give; those that have travel as bits, and only rows in them are shuffled. There a pair
    is taken up if it shares enough tokens and the rest of the sets could make up the overlap. Tokens travel as their
    last 16 bits, which may count some as shared that are not, and never fewer than are. Places with more than ``BLOCK``
    rows are compared block by block.
    """

    def run(key, table):
        found = [_close(*block) for block in _blocks(table)]
        src, dst = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())}).group_by(["src", "dst"]).aggregate([])

    n, cell = F.col("n"), lambda size: F.floor(F.log(size.cast("double")) / float(np.log(CELL))).cast("int")
    low, least = F.ceil(n * UP / DOWN), lambda size: 1 + F.floor(size * LONGER / 100)
    # shared tokens that a pair can have if this one is the first
    left = F.size("tokens") - F.col("at")
    # largest similar set if the own prefix ends first; smallest if the other does, whose rest has at most
    # UP / DOWN of its size and one token more, less what its prefix is longer by
    high = F.floor((n - F.col("length") + left) * (UP + DOWN) / UP) - n
    need = UP / (UP + DOWN)
    other = F.floor((n * need - left - 1) / (UP / DOWN - LONGER / 100 - need)) - 1
    sizes = F.filter(F.sequence(cell(low), cell(n)), lambda c: (c <= cell(F.greatest(high, F.lit(1)))) | (c >= cell(F.greatest(other, F.lit(1)))))
    asks = F.when(left >= least(low), sizes).otherwise(F.array().cast("array<int>"))
    waits = (left >= least(n)) & ((high >= n) | (other <= F.floor(n * DOWN / UP)))
    posted = info.select("node", "group", "n", "length", "tokens", F.posexplode("tokens").alias("at", "token"))
    grouped = written(
        posted.select("token", "node", "group", F.col("at").cast("int").alias("at"), asks.alias("asked"), waits.alias("waits"), cell(n).alias("own")).filter(
            F.col("waits") | (F.size("asked") > 0)
        )
    )
    roles = F.transform("asked", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("asks")))
    role = F.when(F.col("waits"), F.array_append(roles, F.struct(F.col("own").alias("cell"), F.lit(False).alias("asks")))).otherwise(roles)
    spots = grouped.select("token", "node", "group", "at", F.explode(role).alias("s")).select("token", "node", "group", "at", "s.*")
    places = written(
        spots.groupBy("token", "cell")
        .agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count_if("asks").alias("asking"), F.count_if(~F.col("asks")).alias("waiting"))
        .filter("low <> high and asking > 0 and waiting > 0")
        .select("token", "cell", F.ceil(F.col("asking") / BLOCK).cast("int").alias("i_blocks"), F.ceil(F.col("waiting") / BLOCK).cast("int").alias("j_blocks"))
    )
    spots = marked(spots.drop("group"), places, ["token", "cell"])
    block = F.pmod(F.xxhash64("node"), F.when(F.col("asks"), F.col("i_blocks")).otherwise(F.col("j_blocks"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("asks"), F.col("j_blocks")).otherwise(F.col("i_blocks")) - 1)
    tasks = written(
        spots.join(broadcast_when_small(places, ROW_BYTES, NARROW_LIMIT), ["token", "cell"]).withColumn("block", block).withColumn("other", F.explode(others)).select(
            "token", "cell", F.when(F.col("asks"), F.col("block")).otherwise(F.col("other")).alias("i"), F.when(F.col("asks"), F.col("other")).otherwise(F.col("block")).alias("j"), "asks", "node", "at"
        )
    )
    # some ten thousand rows a group; the rows of one block pair stay together
    groups = max(1, tasks.count() // GROUP_ROWS)
    short = info.withColumn("tokens", F.transform("tokens", lambda t: (t.bitwiseAND(0xFFFF) - 0x8000).cast("smallint")))
    behind = F.slice("tokens", F.col("at") + 1, F.size("tokens"))
    dealt = tasks.join(short, "node").withColumn("tokens", behind).drop("at").withColumn("deal", F.pmod(F.xxhash64("token", "cell", "i", "j"), F.lit(groups)))
    return dealt.groupBy("deal").applyInArrow(run, "src bigint, dst bigint")


def _blocks(table: pa.Table) -> Iterator[tuple]:
    """The rows of each block pair as (those that ask, those that wait)."""
    names = ("token", "cell", "i", "j", "node", "group", "n", "matches", "length", "last")
    column = {c: table.column(c).to_numpy() for c in names}
    asks = table.column("asks").to_numpy()
    lists = table.column("tokens").combine_chunks()
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    order = np.lexsort((column["node"], asks, column["j"], column["i"], column["cell"], column["token"]))
    keys = np.stack([column[c][order] for c in ("token", "cell", "i", "j")])
    cuts = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
    for rows in np.split(order, cuts):
        if not len(rows):
            continue
        same = (np.diff(column["node"][rows]) == 0) & (asks[rows][1:] == asks[rows][:-1])
        rows = rows[np.concatenate([[True], ~same])]  # repeated rows of a document
        parts = []
        for role in (True, False):
            own = rows[asks[rows] == role]
            part = {c: column[c][own] for c in ("node", "group", "n", "matches", "length", "last")}
            parts.append(part | {"tokens": [values[offsets[r] : offsets[r + 1]] for r in own]})
        if parts[0]["tokens"] and parts[1]["tokens"]:
            yield tuple(parts)


def _close(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose sets may overlap enough if they share no token before; the larger set is the one that asks.

    Different tokens may look alike here. As often as one stands in a set it counts, so ``shared`` is never too small.
    """
    ranks, flat = np.unique(np.concatenate(left["tokens"] + right["tokens"]), return_inverse=True)

    def matrix(part: dict, at: int) -> np.ndarray:
        sizes = [len(t) for t in part["tokens"]]
        m = np.zeros((len(sizes), len(ranks)), np.float32)
        np.add.at(m, (np.repeat(np.arange(len(sizes)), sizes), flat[at : at + sum(sizes)]), 1)
        return m

    a, b = matrix(left, 0), matrix(right, sum(len(t) for t in left["tokens"]))
    shared = a @ b.T
    la, lb = left["n"][:, None], right["n"][None, :]
    # shared tokens up to the end of the prefix that ends first stand in both prefixes, later ones in the rest of that set
    ra, rb = la - left["length"][:, None], lb - right["length"][None, :]
    ends = left["last"][:, None], right["last"][None, :]
    rest = np.where(ends[0] < ends[1], ra, np.where(ends[0] > ends[1], rb, np.maximum(ra, rb)))
    ok = shared >= np.minimum(left["matches"][:, None], right["matches"][None, :])
    ok &= (DOWN + UP) * (shared + rest) >= UP * (la + lb)
    ok &= DOWN * np.minimum(la, lb) >= UP * np.maximum(la, lb)
    ok &= left["group"][:, None] != right["group"][None, :]
    ok &= (la > lb) | ((la == lb) & (left["node"][:, None] > right["node"][None, :]))
    x, y = np.nonzero(ok)
    return left["node"][x], right["node"][y]


def join(docs: DataFrame) -> DataFrame:
    """(id, tie, n, component, root): set size, smallest id that links reach and group, one row per row of ``docs``.

    Equal sets are one node. Rare shingles stand first in every set, by one frequency estimate over all
    documents, and a set's prefix is what a similar set must meet it in. First every posting list links its
    members to the one of them that meets most others; that joins large groups of near copies without
    forming their pairs. Then the pairs between different groups that the prefixes leave possible are all
    compared, so no link is lost; pairs inside a group could not change it. Documents without words have no
    links; null texts count as empty, null ids as the smallest id.
    """
    classes = frequency_classes(docs)
    signed = signatures(keyed(docs), classes)
    filled = signed.filter("n > 0")
    nodes = filled.groupBy("d1", "d2").agg(F.min(F.struct("id", "tie", "row")).alias("rep")).select("d1", "d2", F.col("rep.row").alias("node"))
    member = written(filled.select("row", "id", "tie", "d1", "d2").join(nodes, ["d1", "d2"]).select("row", "node", "id", "tie"))
    copies = member.filter("row <> node").select("row")
    firsts = filled.join(broadcast_when_small(copies, ROW_BYTES), "row", "left_anti").withColumnRenamed("row", "node")
    met = written(postings(firsts, classes))
    size_of = firsts.select("node", "n", "matches", "last", (F.octet_length("prefix") / 8).cast("int").alias("length"))
    # a set too few of whose prefix tokens are shared has no similar one
    fewest = 1 + F.floor(F.ceil(F.col("n") * UP / DOWN) * LONGER / 100)
    able = written(met.groupBy("node").agg(F.count("*").alias("held")).join(size_of, "node").filter(F.col("held") >= fewest).drop("held"))
    lists = marked(met, able, ["node"])  # and a few other nodes, which ``info`` leaves out again
    # from here on a token is a number in the order of list sizes, so that a pair meets in the smallest list it can
    counted = lists.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = written(counted.repartitionByRange("size", "token").sortWithinPartitions("size", "token").withColumn("number", F.monotonically_increasing_id()))
    lists = lists.join(sizes, "token").select(F.col("number").alias("token"), "node", "size")
    own = lists.groupBy("node").agg(F.sort_array(F.collect_set("token")).alias("tokens"), F.sum("size").alias("met"))
    info = written(own.join(able, "node"))
    first_rows = member.filter("row = node").select("node", "id", "tie")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs)
        wanted = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(first_rows, "node")
        return written(similar(pairs, written(shingle_sets(docs, wanted))))

    held = info.select("node", "met", F.explode("tokens").alias("token"))
    hubs = held.groupBy("token").agg(F.max_by("node", F.struct("met", "node")).alias("hub"))
    stars = held.join(hubs, "token").filter("hub <> node").select(F.col("hub").alias("src"), F.col("node").alias("dst")).distinct()
    links = verified(possible(stars, info))
    found = components(links)
    grouped = written(
        info.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root", "met")
    )
    more = verified(candidates(grouped).distinct())
    merged = components(links.unionByName(more))

    rooted = member.join(merged.withColumnRenamed("id", "node"), "node", "left").select("row", "id", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("id").alias("component"))
    named = rooted.join(lowest, "root").select("row", "component", "root")
    return (
        signed.select("row", "id", "tie", "n").join(named, "row", "left").select("id", "tie", "n", F.coalesce("component", "id").alias("component"), "root")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``; see ``join``."""
    return join(docs).select(real_id().alias("doc_id"), F.col("n").alias("n_shingles"), real_id("component").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns: of each group of near duplicates the one with the smallest (id, text digest).

    Rows with equal id and text are one document; one of them stays. Documents without words stay.
    """
    joined = written(join(docs).dropDuplicates(["id", "tie"]))
    first = joined.filter("n > 0").groupBy("root").agg(F.min(F.struct("id", "tie")).alias("first")).select("first.*")
    kept = first.unionByName(joined.filter("n = 0").select("id", "tie"))
    rows = docs.withColumns({"__id": doc_id(), "__tie": tie()})
    stays = kept.select(F.col("id").alias("__id"), F.col("tie").alias("__tie"))
    return rows.join(stays, ["__id", "__tie"], "left_semi").dropDuplicates(["__id", "__tie"]).select(*docs.columns)
