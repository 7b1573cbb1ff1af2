"""Clusterings of recordings of any size: average linkage, minor clusters, close centres, careful merging of characters."""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.functions import vectors as V
from cliptide.operators import carry, folds, graph, intervals, scoring
from cliptide.operators.carry import Running
from cliptide.session import broadcast_when_small, cut_lineage, fits_broadcast

#: Clusters of one recording whose scores a single task still holds (a matrix of 8 MB): of centres, and of a block.
FOLD_CLUSTERS = 1024
#: Clusters or directions of one recording, and values of their vectors (64 MB), that a single task still links, which holds no scores of
#: all pairs; more are merged in tables.
LINK_CLUSTERS, LINK_VALUES = 131072, 1 << 23
#: Pairs of groups of one graph that a single task still merges, as many as such a matrix has cells.
FOLD_PAIRS = FOLD_CLUSTERS * FOLD_CLUSTERS
#: Mean cosine at which speakers part, chunks from which a recording is long, chunks of a minor
#: cluster at most, and the part of a threshold that all members of a merged group keep.
SPEAKER_FLOOR, LONG_RECORDING, MINOR, KEPT_SHARE = 0.4, 40, 4, 0.9
#: Parts that rows of a hot recording are dealt into when they meet a table that is too large for a broadcast.
SALTS = 16


def _schema(df: DataFrame, keys: list[str], *more: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"{k} {types[k]}" for k in keys), *more])


def _table(keys: list[str], source: pa.Table, rows: int, columns: dict[str, pa.Array]) -> pa.Table:
    held = {k: pa.array([source[k][0].as_py()] * rows, source.schema.field(k).type) for k in keys}
    return pa.table(held | columns)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _sum_arrays(one: Column, two: Column) -> Column:
    return F.zip_with(one, two, lambda x, y: x + y)


def _stored(tables: list[DataFrame], more: DataFrame) -> list[DataFrame]:
    """``tables`` and ``more``, stored; eight tables become one, so that no plan grows with the rounds."""
    tables = [*tables, cut_lineage(more)]
    return tables if len(tables) < 8 else [cut_lineage(functools.reduce(DataFrame.unionByName, tables))]


def cluster_sums(chunks: DataFrame, keys: list[str], order: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Clusters (keys, id, total, n) of equal directions, and edges (keys, src, dst) from a cluster to its other members.

    Equal directions have cosine one, so every linkage joins them first.
    """
    unit = chunks.select(*keys, F.col(order).alias("id"), V.normalize(F.col(vector)).alias("v"))
    same = unit.groupBy(*keys, "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    clusters = same.select(
        *keys, F.col("rep").alias("id"), F.transform("v", lambda x: x * F.col("n")).alias("total"), "n"
    )
    copies = unit.join(same.select(*keys, "v", "rep"), [*keys, "v"]).filter("id <> rep")
    return clusters, copies.select(*keys, F.col("rep").alias("src"), F.col("id").alias("dst"))


def nearest_clusters(clusters: DataFrame, keys: list[str], floor: float, block_rows: int) -> DataFrame:
    """(keys, id, other, score): the most similar other cluster of each, by mean cosine, if it reaches ``floor``.

    The mean over all pairs of two clusters is the product of their means. Blocks meet only where the directions
    allow it, and a meeting sends one row per cluster. Ties go to the smaller id.
    """
    mean = F.transform("total", lambda x: x / F.col("n"))
    rows = clusters.select(*keys, "id", V.normalize(mean).alias("v"), F.sqrt(V.dot(mean, mean)).alias("length"))
    # a mean is no longer than one, so a product above a positive floor needs a cosine above it
    dealt = graph.block_pairs(rows, keys, floor if floor > 0 else -1.0, block_rows, ["length"])
    kind = dict(rows.dtypes)["id"]

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, side = np.asarray(table["id"].to_pylist()), table["side"].to_numpy()
        v = _matrix(table["v"]) * table["length"].to_numpy()[:, None]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(b)
        scores = np.round(v[a] @ (v[a] if alone else v[b]).T, V.SCORE_DIGITS)
        if alone:
            np.fill_diagonal(scores, -np.inf)
            b = a
        found = []
        for own, others, matrix in ((a, b, scores), *(() if alone else ((b, a, scores.T),))):
            best = matrix.argmax(1)  # the first of equal ones, and ids are sorted
            top = matrix[np.arange(len(own)), best]
            good = top >= floor
            found.append((ids[own[good]], ids[others[best[good]]], top[good]))
        mine, other, top = (np.concatenate(x) for x in zip(*found, strict=True))
        arrow = table.schema.field("id").type
        return _table(keys, table, len(mine), {"id": pa.array(mine.tolist(), arrow), "other": pa.array(other.tolist(), arrow), "score": pa.array(top)})

    met = dealt.groupBy(*keys, "b1", "b2").applyInArrow(meet, _schema(rows, keys, f"id {kind}", f"other {kind}", "score double"))
    best = met.groupBy(*keys, "id").agg(F.min(F.struct((-F.col("score")).alias("less"), "other")).alias("best"))
    return best.select(*keys, "id", "best.other", (-F.col("best.less")).alias("score"))


def _beyond(rows: DataFrame, keys: list[str], vector: str, most: int) -> DataFrame:
    """Keys of recordings with more than ``most`` rows or more than ``LINK_VALUES`` values of vectors."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__rows"), F.sum(F.size(vector)).alias("__values"))
    return sizes.filter((F.col("__rows") > most) | (F.col("__values") > LINK_VALUES)).select(*keys)


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Recordings dealt evenly among the tasks: few rows take long, so that by hashes or by bytes some tasks would end late."""
    spark = rows.sparkSession
    return rows.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def _rooted(keys: list[str], table: pa.Table, root: np.ndarray) -> pa.Table:
    """Edges from the first row of each group to its other rows."""
    ids, arrow = table["id"].to_pylist(), table.schema.field("id").type
    at = np.flatnonzero(root != np.arange(len(root)))
    ends = {"src": pa.array([ids[k] for k in root[at].tolist()], arrow), "dst": pa.array([ids[k] for k in at.tolist()], arrow)}
    return _table(keys, table, len(at), ends)


def _fold(clusters: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """Edges of the merges of recordings that one task links."""
    kind = dict(clusters.dtypes)["id"]

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        return _rooted(keys, table, folds.linked(_matrix(table["total"]), table["n"].to_numpy(), floor))

    return _dealt(clusters, keys).groupBy(*keys).applyInArrow(fold, _schema(clusters, keys, f"src {kind}", f"dst {kind}"))


def linkage_edges(
    chunks: DataFrame, keys: list[str], order: str, vector: str, floor: float, fold_clusters: int = LINK_CLUSTERS
) -> DataFrame:
    """Edges (keys, src, dst) that join the chunks of each cluster of average linkage, cut at mean cosine ``floor``.

    Average linkage is reducible: two clusters that are each other's nearest are merged sooner or later
    whatever else is, so each round merges all such pairs of a recording at once. A cluster is the sum of its unit
    vectors and a count. A cluster that is near none is done, since a merge brings it no nearer to others than both parts were.
    A recording goes through rounds of tables until at most ``fold_clusters`` clusters are not done; then one task ends it, which
    holds their sums and a block of scores.
    A cluster that takes its members one by one needs a round for each while it is in tables.
    """
    clusters, edges = cluster_sums(chunks, keys, order, vector)
    clusters, edges = cut_lineage(clusters), [edges]
    while True:
        large = cut_lineage(_beyond(clusters, keys, "total", fold_clusters))
        edges = _stored(edges, _fold(clusters.join(large, keys, "left_anti"), keys, floor))
        if large.isEmpty():
            break
        clusters = cut_lineage(clusters.join(large, keys, "left_semi"))
        near = cut_lineage(nearest_clusters(clusters, keys, floor, min(fold_clusters, FOLD_CLUSTERS)))
        back = near.select(*keys, F.col("other").alias("id"), F.col("id").alias("__back"))
        mutual = near.join(back, [*keys, "id"]).filter((F.col("other") == F.col("__back")) & (F.col("id") < F.col("other")))
        merges = cut_lineage(mutual.select(*keys, F.col("id").alias("src"), F.col("other").alias("dst")))
        clusters = clusters.join(near.select(*keys, "id"), [*keys, "id"], "left_semi")
        gone = merges.join(
            clusters.select(*keys, F.col("id").alias("dst"), F.col("total").alias("__total"), F.col("n").alias("__n")), [*keys, "dst"]
        ).withColumnRenamed("src", "id")
        kept = clusters.join(merges.select(*keys, F.col("dst").alias("id")), [*keys, "id"], "left_anti")
        clusters = cut_lineage(
            kept.join(gone.drop("dst"), [*keys, "id"], "left").select(
                *keys,
                "id",
                F.when(F.col("__n").isNull(), F.col("total")).otherwise(_sum_arrays(F.col("total"), F.col("__total"))).alias("total"),
                (F.col("n") + F.coalesce("__n", F.lit(0))).alias("n"),
            )
        )
        edges = _stored(edges, merges)
    return functools.reduce(DataFrame.unionByName, edges)


def numbered(rows: DataFrame, edges: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Number the components of ``edges`` from zero by their first row; rows without an edge are on their own."""
    found = graph.connected_components(edges, keys).withColumnRenamed("node_id", order)
    rooted = rows.join(found, [*keys, order], "left").withColumn("root", F.coalesce("root", order))
    return graph.number_groups(rooted, keys, "root", 65536, name).drop("root")


def average_linkage(
    chunks: DataFrame, keys: list[str], order: str, vector: str, floor: float = SPEAKER_FLOOR, fold_clusters: int = LINK_CLUSTERS
) -> DataFrame:
    """(keys, order, speaker) by average linkage of the chunks of each recording, numbered by their first chunk."""
    edges = linkage_edges(chunks, keys, order, vector, floor, fold_clusters)
    return numbered(chunks.select(*keys, order), edges, keys, order, "speaker")


def centres(chunks: DataFrame, labels: DataFrame, keys: list[str], order: str, vector: str, label: str) -> DataFrame:
    """(keys, label, centre): the mean vector of each cluster."""
    return scoring.centroid(chunks.join(labels, [*keys, order]), [*keys, label], vector, "centre")


def _meet_all(rows: DataFrame, others: DataFrame, keys: list[str], row_bytes: int) -> DataFrame:
    """Every row beside every row of ``others`` with its keys, which is broadcast if it fits and else met in ``SALTS`` parts."""
    if fits_broadcast(others, row_bytes):
        return rows.join(F.broadcast(others), keys)
    salted = others.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"]).drop("__salt")


def without_minor(
    chunks: DataFrame, labels: DataFrame, keys: list[str], order: str, vector: str, label: str, least: int = MINOR
) -> DataFrame:
    """Chunks of clusters with at most ``least`` members go to the larger cluster whose centre is nearest by cosine.

    In a recording without a larger cluster all chunks get the first label. Ties go to the smaller label.
    """
    sizes = labels.groupBy(*keys, label).agg(F.count("*").alias("__n"))
    marked = cut_lineage(labels.join(sizes.select(*keys, label, (F.col("__n") > least).alias("__major")), [*keys, label]))
    majors = marked.filter("__major").select(*keys, order, label)
    middle = centres(chunks, majors, keys, order, vector, label).select(
        *keys, F.col(label).alias("__new"), V.normalize(F.col("centre")).alias("__centre")
    )
    asked = chunks.join(marked.filter(~F.col("__major")), [*keys, order]).select(*keys, order, V.normalize(F.col(vector)).alias("__v"))
    met = _meet_all(asked, cut_lineage(middle), keys, scoring.QUERY_BYTES)
    score = F.round(V.dot(F.col("__v"), F.col("__centre")), V.SCORE_DIGITS)
    moved = met.groupBy(*keys, order).agg(F.min(F.struct((-score).alias("s"), "__new")).alias("__best"))
    first = labels.groupBy(*keys).agg(F.min(label).alias("__first"))
    return (
        marked.join(moved.select(*keys, order, F.col("__best.__new").alias("__new")), [*keys, order], "left")
        .join(broadcast_when_small(first, 256), keys)
        .select(*keys, order, F.when(F.col("__major"), F.col(label)).otherwise(F.coalesce("__new", "__first")).alias(label))
    )


def merged_centres(
    chunks: DataFrame, labels: DataFrame, keys: list[str], order: str, vector: str, label: str, floor: float,
    fold_clusters: int = FOLD_CLUSTERS,
) -> DataFrame:
    """Merge the two clusters of a recording whose centres are nearest, again and again while their cosine reaches ``floor``.

    A merged centre is the mean of all members. It can come nearer to a third than both were, so pairs go strictly in turn: one per recording
    and round in tables while a recording has more than ``fold_clusters`` clusters, the rest in one task. The smaller label stays.
    """
    joined = chunks.select(*keys, order, vector).join(labels, [*keys, order])
    sizes = joined.groupBy(*keys, label).agg(F.count("*").alias("n"))
    clusters = scoring.centroid(joined, [*keys, label], vector, "centre").join(sizes, [*keys, label])
    clusters = cut_lineage(clusters.select(*keys, F.col(label).alias("id"), F.transform("centre", lambda x: x * F.col("n")).alias("total"), "n"))
    edges = []
    while True:
        count = clusters.groupBy(*keys).agg(F.count("*").alias("__clusters"))
        large = count.filter(F.col("__clusters") > fold_clusters).select(*keys)
        edges.append(_fold_centres(clusters.join(large, keys, "left_anti"), keys, floor))
        if large.isEmpty():
            break
        clusters = cut_lineage(clusters.join(large, keys, "left_semi"))
        # with one for the count the score of two clusters is the cosine of their directions
        unit = clusters.select(*keys, "id", V.normalize(F.col("total")).alias("total"), F.lit(1).cast("bigint").alias("n"))
        near = nearest_clusters(unit, keys, floor, fold_clusters)
        pair = F.struct((-F.col("score")).alias("s"), F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"))
        merges = cut_lineage(near.groupBy(*keys).agg(F.min(pair).alias("p")).select(*keys, "p.src", "p.dst"))
        clusters = clusters.join(merges.select(*keys), keys, "left_semi")
        into = clusters.join(merges.withColumnRenamed("dst", "id"), [*keys, "id"], "left").select(
            *keys, F.coalesce("src", "id").alias("id"), "total", "n"
        )
        sums = scoring.centroid(into, [*keys, "id"], "total", "__mean").join(
            into.groupBy(*keys, "id").agg(F.sum("n").alias("n"), F.count("*").alias("__k")), [*keys, "id"]
        )
        clusters = cut_lineage(sums.select(*keys, "id", F.transform("__mean", lambda x: x * F.col("__k")).alias("total"), "n"))
        edges.append(merges)
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    found = graph.connected_components(out, keys).withColumnRenamed("node_id", label)
    return labels.join(found, [*keys, label], "left").select(*keys, order, F.coalesce("root", label).alias(label))


def _fold_centres(clusters: DataFrame, keys: list[str], floor: float) -> DataFrame:
    kind = dict(clusters.dtypes)["id"]

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        total, ids = _matrix(table["total"]).copy(), table["id"].to_pylist()
        live = list(range(len(ids)))
        merges = []
        while len(live) > 1:
            unit = total[live] / np.maximum(np.linalg.norm(total[live], axis=1, keepdims=True), 1e-12)
            scores = np.round(unit @ unit.T, V.SCORE_DIGITS)
            scores[np.tril_indices(len(live))] = -np.inf
            a, b = np.unravel_index(scores.argmax(), scores.shape)
            if scores[a, b] < floor:
                break
            merges.append((live[a], live[b]))
            total[live[a]] += total[live[b]]
            del live[b]
        arrow = table.schema.field("id").type
        ends = {name: pa.array([ids[m[side]] for m in merges], arrow) for side, name in enumerate(("src", "dst"))}
        return _table(keys, table, len(merges), ends)

    return clusters.groupBy(*keys).applyInArrow(fold, _schema(clusters, keys, f"src {kind}", f"dst {kind}"))


def relabelled(labels: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """Labels numbered from zero by the first row that has them."""
    first = labels.groupBy(*keys, label).agg(F.min(order).alias("__first"))
    placed = graph.number_groups(first, keys, "__first", 65536, "__number")
    return labels.join(placed.drop("__first"), [*keys, label]).select(*keys, order, F.col("__number").alias(label))


def speakers(
    chunks: DataFrame, keys: list[str], order: str, vector: str, floor: float = SPEAKER_FLOOR, least: int = MINOR,
    merge_floor: float | None = None, fold_clusters: int = FOLD_CLUSTERS, link_clusters: int = LINK_CLUSTERS,
) -> DataFrame:
    """Speaker of every chunk: linkage, then minor clusters dissolved, then close centres merged if ``merge_floor`` is given.

    Numbered from zero by first chunk; a recording of one chunk has speaker zero.
    """
    labels = cut_lineage(average_linkage(chunks, keys, order, vector, floor, link_clusters))
    labels = cut_lineage(without_minor(chunks, labels, keys, order, vector, "speaker", least))
    if merge_floor is not None:
        labels = merged_centres(chunks, labels, keys, order, vector, "speaker", merge_floor, fold_clusters)
    return relabelled(labels, keys, order, "speaker")


def _fold_careful(rows: DataFrame, keys: list[str], threshold: float, floor: float) -> DataFrame:
    """Edges of the careful merges of graphs that one task links."""
    kind = dict(rows.dtypes)["id"]

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        return _rooted(keys, table, folds.careful(_matrix(table["v"]), threshold, floor))

    return _dealt(rows, keys).groupBy(*keys).applyInArrow(fold, _schema(rows, keys, f"src {kind}", f"dst {kind}"))


def _fold_fitting(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of the careful merges of graphs with few fitting pairs of groups (src, dst, first), from the first pair on.

    A merged group fits what both its parts fitted, and its first pair with that is the first of both.
    """
    kind = dict(pairs.dtypes)["src"]

    def fold(table: pa.Table) -> pa.Table:
        fits: dict = {}
        queue = []
        for src, dst, first in zip(*(table[c].to_pylist() for c in ("src", "dst", "first")), strict=True):
            rank = None if first is None else (first["s"], first["a"], first["b"])
            fits.setdefault(src, {})[dst] = fits.setdefault(dst, {})[src] = rank
            if rank is not None:
                queue.append((rank, src, dst))
        heapq.heapify(queue)
        merges = []
        while queue:
            rank, src, dst = heapq.heappop(queue)
            if fits.get(src, {}).get(dst) != rank:
                continue
            merges.append((src, dst))
            one, two = fits[src], fits.pop(dst)
            for other in two:
                del fits[other][dst]
            for other in [o for o in one if o not in two]:
                del one[other], fits[other][src]
            for other, own in one.items():
                theirs = two[other]
                if theirs is not None and (own is None or theirs < own):
                    one[other] = fits[other][src] = theirs
                    heapq.heappush(queue, (theirs, min(src, other), max(src, other)))
        arrow = table.schema.field("src").type
        ends = {name: pa.array([m[side] for m in merges], arrow) for side, name in enumerate(("src", "dst"))}
        return _table(keys, table, len(merges), ends)

    return pairs.groupBy(*keys).applyInArrow(fold, _schema(pairs, keys, f"src {kind}", f"dst {kind}"))


def _careful_tables(
    rows: DataFrame, large: DataFrame, keys: list[str], threshold: float, floor: float, block_rows: int, fold_pairs: int
) -> list[DataFrame]:
    """Edges of the careful merges of graphs that are too large for one task, from tables of the pairs of groups that fit."""
    merges: list[DataFrame] = []
    dealt = graph.block_pairs(rows, keys, floor if floor > 0 else -1.0, block_rows, ["n"])
    kind = dict(rows.dtypes)["id"]

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, side, n = table["id"].to_pylist(), table["side"].to_numpy(), table["n"].to_numpy()
        v = _matrix(table["v"])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(b)
        b = a if alone else b
        scores = np.round(v[a] @ v[b].T, V.SCORE_DIGITS)
        i, j = np.nonzero(scores >= floor)
        if alone:
            i, j = i[i < j], j[i < j]
        low, high = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
        arrow = table.schema.field("id").type
        columns = {
            "src": pa.array([ids[k] for k in low.tolist()], arrow),
            "dst": pa.array([ids[k] for k in high.tolist()], arrow),
            "score": pa.array(scores[i, j]),
            "good": pa.array(n[low] * n[high]),
        }
        return _table(keys, table, len(low), columns)

    schema = _schema(rows, keys, f"src {kind}", f"dst {kind}", "score double", "good bigint")
    pairs = dealt.groupBy(*keys, "b1", "b2").applyInArrow(meet, schema)
    order = F.when(F.col("score") >= threshold, F.struct((-F.col("score")).alias("s"), F.col("src").alias("a"), F.col("dst").alias("b")))
    between = cut_lineage(pairs.select(*keys, "src", "dst", "good", order.alias("first")))
    sizes = cut_lineage(rows.select(*keys, "id", "n"))
    while not large.isEmpty():
        fits = between
        for end in ("src", "dst"):
            fits = fits.join(sizes.withColumnsRenamed({"id": end, "n": f"__{end}"}), [*keys, end])
        fits = cut_lineage(fits.filter(F.col("good") == F.col("__src") * F.col("__dst")).drop("__src", "__dst"))
        going = fits.filter(F.col("first").isNotNull()).select(*keys, F.explode(F.array("src", "dst")).alias("id"), "first")
        going = cut_lineage(going.groupBy(*keys, "id").agg(F.min("first").alias("__best")))
        for end in ("src", "dst"):
            fits = fits.join(going.withColumnsRenamed({"id": end, "__best": f"__{end}"}), [*keys, end])
        fits = cut_lineage(fits)
        counts = fits.groupBy(*keys).agg(F.count("*").alias("__pairs"))
        large = cut_lineage(counts.filter(F.col("__pairs") > fold_pairs).select(*keys))
        merges = _stored(merges, _fold_fitting(fits.join(large, keys, "left_anti").select(*keys, "src", "dst", "first"), keys))
        if large.isEmpty():
            break
        fits = fits.join(large, keys, "left_semi")
        taken = cut_lineage(fits.filter((F.col("first") == F.col("__src")) & (F.col("first") == F.col("__dst"))).select(*keys, "src", "dst"))
        merges = _stored(merges, taken)
        into = taken.select(*keys, F.col("dst").alias("id"), F.col("src").alias("__into"))
        sizes = cut_lineage(
            sizes.join(into, [*keys, "id"], "left").groupBy(*keys, F.coalesce("__into", "id").alias("id")).agg(F.sum("n").alias("n"))
        )
        moved = fits.drop("__src", "__dst")
        for end in ("src", "dst"):
            moved = moved.join(into.withColumnsRenamed({"id": end, "__into": f"__{end}"}), [*keys, end], "left").withColumn(end, F.coalesce(f"__{end}", end)).drop(f"__{end}")
        low, high = F.least("src", "dst"), F.greatest("src", "dst")
        between = moved.filter("src <> dst").groupBy(*keys, low.alias("src"), high.alias("dst")).agg(F.sum("good").alias("good"), F.min("first").alias("first"))
    return merges


def careful_merges(
    characters: DataFrame, keys: list[str], node: str, vector: str, threshold: float,
    fold_clusters: int = LINK_CLUSTERS, block_rows: int = 1024, fold_pairs: int = FOLD_PAIRS,
) -> DataFrame:
    """(keys, node, group) of characters merged from the most similar pair on, if all members of both sides stay similar.

    Pairs with cosine >= ``threshold`` are taken in order (ties by ids); a pair joins the groups of its ends
    if every cosine between them is at least ``KEPT_SHARE`` of the threshold. A graph of up to ``fold_clusters`` distinct directions is
    merged by one task, which holds the vectors and a block of scores. For one of more, kept per two groups are the number of such
    good pairs and their first pair in order. Groups fit if that number is the product of their sizes; groups that do
    not fit never will, and are dropped. A pair that comes first for both its groups depends on nothing that is
    still open, so all such pairs of a round are settled at once. A group without an open pair is done, and so are its pairs: a merge
    of another group opens none. One task ends the graph as soon as at most ``fold_pairs`` pairs of groups are left; a group that takes its
    members one by one needs a round for each until then.
    """
    unit = characters.select(*keys, F.col(node).alias("id"), V.normalize(F.col(vector)).alias("v"))
    same = unit.groupBy(*keys, "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    copies = unit.join(same.select(*keys, "v", "rep"), [*keys, "v"]).filter("id <> rep")
    every = cut_lineage(same.select(*keys, F.col("rep").alias("id"), "v", "n"))
    floor = round(KEPT_SHARE * threshold, 12)
    large = cut_lineage(_beyond(every, keys, "v", fold_clusters))
    merges = [
        copies.select(*keys, F.col("rep").alias("src"), F.col("id").alias("dst")),
        _fold_careful(every.join(large, keys, "left_anti").drop("n"), keys, threshold, floor),
    ]
    if not large.isEmpty():
        merges += _careful_tables(every.join(large, keys, "left_semi"), large, keys, threshold, floor, block_rows, fold_pairs)
    out = functools.reduce(DataFrame.unionByName, merges)
    return numbered(characters.select(*keys, node), out, keys, node, "group")


def face_intervals(frames: DataFrame, keys: list[str], time: str, face: str, gap: float, chunk: Column | None = None) -> DataFrame:
    """(keys, start, end, face): runs of frames with one face and no pause above ``gap``; single frames are left out."""
    frames = frames.select(*keys, time, face)
    before = {"__face": Running("last", F.col(face), inclusive=False), "__time": Running("last", F.col(time), inclusive=False)}
    chunk = carry.chunk_if_hot(frames, keys, chunk) if chunk is not None else None
    seen = carry.running(frames, keys, [time], chunk, before)
    same = (F.col("__face") == F.col(face)) & (F.col(time) - F.col("__time") <= gap)
    seen = carry.settled(seen.withColumn("__new", F.when(same, 0).otherwise(1)), chunk)
    runs = carry.running(seen, keys, [time], chunk, {"__run": Running("sum", F.col("__new"))})
    spans = runs.groupBy(*keys, "__run", face).agg(F.min(time).alias("start"), F.max(time).alias("end"))
    return spans.filter(F.col("end") - F.col("start") >= 1e-4).select(*keys, "start", "end", face)


def joint_speakers(
    audio: DataFrame, faces: DataFrame, keys: list[str], order: str, vector: str, speaker: str, face: str, width: int = 30,
    shared: float = 1.0, least: float = 0.5,
) -> DataFrame:
    """(keys, order, speaker): audio labels corrected by the faces that are seen meanwhile, numbered by first chunk.

    ``audio``: keys, order, start, end, vector, speaker. ``faces``: keys, start, end, face, from ``face_intervals``. A face sounds like the mean
    of the chunks that share more than ``shared`` seconds with an interval of it; faces without one are not used. A speaker whose chunks share
    more than ``least`` seconds with a face, or half of the face's time if that is less, is divided among all such faces by the nearest
    mean; a speaker without a face keeps the audio label. Ties go to the smaller face.
    """
    chunks = audio.select(*keys, order, "start", "end", speaker, V.normalize(F.col(vector)).alias("__v"), F.col(vector).alias("__raw"))
    spans = chunks.select(*keys, order, "start", "end")
    pairs = intervals.overlap_join(spans, faces, keys, ("start", "end"), width)
    heard = pairs.filter(intervals.overlap_length(("start", "end")) > shared).select(*keys, F.col(f"l_{order}").alias(order), F.col(f"r_{face}").alias(face))
    sounds = scoring.centroid(heard.join(chunks.select(*keys, order, "__raw"), [*keys, order]), [*keys, face], "__raw", "__sound")
    sounds = cut_lineage(sounds.withColumn("__sound", V.normalize(F.col("__sound"))))
    known = faces.join(sounds.select(*keys, face), [*keys, face], "left_semi")
    own = [*keys, speaker]
    placed = carry.islands(chunks, own, "start", "end", order, carry.chunk_if_hot(chunks, own, F.floor(F.col("start") / 3600)), 0)
    merged = placed.groupBy(*own, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    seen = cut_lineage(intervals.overlapping_speakers(merged, known, keys, speaker, face, width, least).select(*own, face))
    options = chunks.join(seen, own).join(sounds, [*keys, face])
    score = F.round(V.dot(F.col("__v"), F.col("__sound")), V.SCORE_DIGITS)
    best = options.groupBy(*keys, order).agg(F.min(F.struct((-score).alias("s"), F.col(face).alias("f"))).alias("__best"))
    labels = chunks.join(best, [*keys, order], "left").select(
        *keys,
        order,
        F.when(F.col("__best").isNull(), F.concat(F.lit("voice "), F.col(speaker).cast("string")))
        .otherwise(F.concat(F.lit("face "), F.col("__best.f").cast("string")))
        .alias("speaker"),
    )
    return relabelled(cut_lineage(labels), keys, order, "speaker")
