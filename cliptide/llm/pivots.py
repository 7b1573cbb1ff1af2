"""Embedding near-dedup by a pivot-permutation index."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import NO_ID, components, real_id, written

#: Cosine from which vectors link.
COSINE = 0.95
#: Reference points: one for so many vectors, within bounds; drawn from the data in digest order.
PER_PIVOT, FEWEST, MOST = 128, 64, 2048
#: Nearest reference points that describe a vector, and how many of them a pair must share: the more points there
#: are, the fewer of its nearest a pair at the threshold has in common. With up to ``FINE`` points the first number holds.
NEAREST, SHARED, FINE = 6, (3, 2), 256
#: Vectors of a pivot list that one task compares with as many others; rows that one call compares.
BLOCK, GROUP_ROWS = 1024, 20_000


def prepared(vectors: DataFrame) -> DataFrame:
    """(id, unit): the unit vector in double precision, null where a vector cannot be compared."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # scaled by the largest component first, so that no square overflows or vanishes
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NO_ID)).alias("id"), doubles.alias("v"))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("v", F.when(sound, F.col("v"))).withColumn("top", F.when(top > 0, top))
    rows = rows.withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("norm", norm).select("id", F.when(F.col("top").isNotNull(), F.transform("v", lambda x: x / F.col("norm"))).alias("unit"))


def pivots(points: DataFrame) -> np.ndarray:
    """Reference points: vectors with the smallest digests, ``MOST`` at most."""
    n = points.count()
    k = int(min(MOST, max(FEWEST, n // PER_PIVOT)))
    rows = points.select("unit").orderBy(F.xxhash64("unit"), "node").limit(k).toArrow().column("unit").to_pylist()
    width = max(map(len, rows), default=0)
    chosen = [r for r in rows if len(r) == width]
    return np.array(chosen, np.float64).reshape(len(chosen), width)


def described(points: DataFrame, anchors: np.ndarray) -> DataFrame:
    """One row per set of ``SHARED`` of a vector's nearest pivots: (key, node, copies, unit, near)."""
    shipped = points.sparkSession.sparkContext.broadcast(anchors)
    least = SHARED[len(anchors) > FINE]

    def run(batches):
        for batch in batches:
            pivots = shipped.value
            lists = batch.column(1).to_pylist()
            owner, keys, near = [], [], []
            fits = [k for k, v in enumerate(lists) if len(v) == pivots.shape[1]]
            if fits:
                order = np.argsort(-np.array([lists[k] for k in fits]) @ pivots.T, axis=1, kind="stable")[:, : min(NEAREST, len(pivots))]
                for k, row in zip(fits, order.tolist(), strict=True):
                    for subset in combinations(sorted(row), min(least, len(row))):
                        owner.append(k)
                        keys.append(np.array(subset, np.int16).tobytes())
                        near.append(row)
            # other widths meet only their own kind
            for k in sorted(set(range(len(lists))) - set(fits)):
                owner.append(k)
                keys.append(b"width" + str(len(lists[k])).encode())
                near.append([])
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), batch.column(0).take(at), batch.column(1).take(at), pa.array(near, pa.list_(pa.int32()))],
                names=["key", "node", "unit", "near"],
            )

    return points.select("node", "unit").mapInArrow(run, "key binary, node bigint, unit array<double>, near array<int>")


def linked(points: DataFrame, anchors: np.ndarray) -> DataFrame:
    """(node, root, links) for the nodes that link in a part of a pivot list; ``links`` counts the rows linked there.

    ``points`` holds (node, copies, unit). A list holds the vectors that share ``SHARED`` pivots, so meeting in a list is
    the count of shared pivots; a pair is compared in the first of its lists only. Long lists go block by block.
    """

    def run(key, table):
        out = [_compare(*block) for block in _blocks(table)]
        node, root, links = (np.concatenate([o[k] for o in out] or [np.zeros(0, np.int64)]) for k in range(3))
        return pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64()), "links": pa.array(links, pa.int64())})

    listed = written(described(points, anchors))
    sizes = listed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = listed.join(sizes, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "near"
    )
    tasks = written(spread)
    groups = max(1, tasks.count() // GROUP_ROWS)
    dealt = tasks.join(points, "node").withColumn("deal", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)))
    return dealt.groupBy("deal").applyInArrow(run, "node bigint, root bigint, links bigint")


def _blocks(table: pa.Table):
    """The rows of each block pair: (key, members of the first block, members of the other, equal blocks)."""
    keys = table.column("key").to_pylist()
    i, j, block, node, copies = (table.column(c).to_numpy() for c in ("i", "j", "block", "node", "copies"))
    order = sorted(range(len(keys)), key=lambda r: (keys[r], i[r], j[r], node[r]))
    units, near = table.column("unit").to_pylist(), table.column("near").to_pylist()
    start = 0
    while start < len(order):
        r, stop = order[start], start
        while stop < len(order) and (keys[order[stop]], i[order[stop]], j[order[stop]]) == (keys[r], i[r], j[r]):
            stop += 1
        rows, parts = order[start:stop], []
        for b in (i[r], j[r]):
            own = [x for x in rows if block[x] == b]
            parts.append((np.array([node[x] for x in own]), np.array([copies[x] for x in own]), [units[x] for x in own], [near[x] for x in own]))
        if all(len(p[0]) for p in parts) and (i[r] != j[r] or len(parts[0][0]) > 1):
            yield keys[r], parts[0], parts[1], bool(i[r] == j[r])
        start = stop


def _compare(key: bytes, left: tuple, right: tuple, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    close = np.array(left[2]) @ np.array(right[2]).T >= COSINE
    if left[3][0]:
        shared = np.frombuffer(key, np.int16)

        def low(near: list[list[int]]) -> np.ndarray:
            m = np.zeros((len(near), int(shared[-1]) + 1), np.float32)
            for row, own in enumerate(near):
                m[row, [p for p in own if p <= shared[-1]]] = 1
            return m

        # in no earlier list: up to the last pivot of this one they share no other
        close &= low(left[3]) @ low(right[3]).T == len(shared)
    if same:
        np.fill_diagonal(close, False)
    n = len(left[0])
    if same:
        nodes, adjacent, links = left[0], close, close @ left[1]
    else:
        nodes = np.concatenate([left[0], right[0]])
        adjacent = np.zeros((len(nodes), len(nodes)), bool)
        adjacent[:n, n:], adjacent[n:, :n] = close, close.T
        links = np.concatenate([close @ right[1], close.T @ left[1]])
    root = np.full(len(nodes), -1)
    for k in range(len(nodes)):
        if root[k] < 0 and links[k]:
            front = np.array([k])
            root[k] = k
            while len(front):
                front = np.flatnonzero(adjacent[front].any(0) & (root < 0))
                root[front] = k
    some = links > 0
    return nodes[some], nodes[root[some]], links[some].astype(np.int64)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding).

    Equal vectors are one point with a number of copies. Each point is described by its ``NEAREST`` reference
    points out of a bounded sample of the data; points that share ``SHARED`` of them meet in an inverted
    list and are compared by their cosine in double precision, so no link is false. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing and keep their own id;
    so do vectors of another length. Rows that repeat an id are vectors of their own; null ids rank first.
    """
    rows = written(prepared(vectors))
    sound = rows.filter("unit is not null")
    points = written(sound.groupBy("unit").agg(F.count("*").alias("copies"), F.min("id").alias("low")).withColumn("node", F.monotonically_increasing_id()))
    found = written(linked(points.select("node", "copies", "unit"), pivots(points)))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    described_points = (
        points.join(counts, "node", "left")
        .join(groups.withColumnRenamed("id", "node"), "node", "left")
        .select("unit", "copies", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    )
    lowest = described_points.groupBy("root").agg(F.min("low").alias("component"))
    named = described_points.join(lowest, "root")
    full = sound.join(named, "unit").select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component")
    alone = rows.filter("unit is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return full.unionByName(alone).select(
        real_id().alias("vec_id"), F.col("n_links").cast("bigint"), real_id("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )
