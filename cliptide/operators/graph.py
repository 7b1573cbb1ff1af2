"""Memory-graph operators on node and edge tables.

``nodes``: graph, node_id, type, clip_id, content. ``edges``: graph, src, dst, weight, stored in
both directions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.functions import vectors as V
from cliptide.operators import carry, scoring
from cliptide.session import cut_lineage

#: Weights of structural edges and the tolerance they are recognised with.
DIALOGUE_WEIGHT = 0.5
SCENE_WEIGHT = 0.6
WEIGHT_TOLERANCE = 0.01
TEXT_TYPES = ["episodic", "semantic"]


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(*others, F.col("dst").alias("src"), F.col("src").alias("dst")))


def valid_edges(edges: DataFrame, nodes: DataFrame, graph: list[str]) -> DataFrame:
    """Edges whose ends exist and are not two text nodes of one type."""
    ends = nodes.select(*graph, "node_id", "type")
    typed = (
        edges.join(ends.withColumnsRenamed({"node_id": "src", "type": "src_type"}), [*graph, "src"])
        .join(ends.withColumnsRenamed({"node_id": "dst", "type": "dst_type"}), [*graph, "dst"])
    )
    clash = (F.col("src_type") == F.col("dst_type")) & F.col("src_type").isin(TEXT_TYPES)
    return typed.filter(~clash).drop("src_type", "dst_type")


def neighbours(edges: DataFrame, nodes: DataFrame, graph: list[str], types: list[str]) -> DataFrame:
    """Distinct (src, dst) with the far end of one of ``types``."""
    wanted = nodes.filter(F.col("type").isin(types)).select(*graph, F.col("node_id").alias("dst"))
    return edges.select(*graph, "src", "dst").join(wanted, [*graph, "dst"], "left_semi").distinct()


def without_structure(edges: DataFrame, weight: float, both_types: str | None = None) -> DataFrame:
    """Drop edges of one structural weight (only between two nodes of a type, if given)."""
    hit = F.abs(F.col("weight") - weight) < WEIGHT_TOLERANCE
    if both_types:
        hit = hit & (F.col("src_type") == both_types) & (F.col("dst_type") == both_types)
    return edges.filter(~hit)


def scene_nodes(edges: DataFrame, graph: list[str]) -> DataFrame:
    """Nodes all of whose edges are scene edges."""
    scene = F.abs(F.col("weight") - SCENE_WEIGHT) < WEIGHT_TOLERANCE
    return edges.groupBy(*graph, "src").agg(F.every(scene).alias("all_scene")).filter("all_scene").drop("all_scene")


def adjust_weights(edges: DataFrame, changes: DataFrame, graph: list[str]) -> DataFrame:
    """Reinforce or weaken nodes: every incident edge moves by twice the node's delta.

    ``changes`` holds (graph, node_id, delta); edges at or below zero disappear. Deltas of both
    ends add up, so the order of changes does not matter here.
    """
    delta = changes.groupBy(*graph, "node_id").agg(F.sum("delta").alias("delta"))
    out = edges
    for end in ("src", "dst"):
        out = out.join(
            delta.withColumnsRenamed({"node_id": end, "delta": f"{end}_delta"}), [*graph, end], "left"
        )
    moved = F.coalesce("src_delta", F.lit(0.0)) + F.coalesce("dst_delta", F.lit(0.0))
    return (
        out.withColumn("weight", F.col("weight") + 2.0 * moved)
        .drop("src_delta", "dst_delta")
        .filter("weight > 0")
    )


def strongest_equivalence(
    links: DataFrame, keys: list[str], weight: str, node: str, has_face: Column
) -> DataFrame:
    """Keep every link without a face and, per voice, the heaviest link with one (lowest node on ties)."""
    best = links.filter(has_face & (F.col(weight) > 0)).groupBy(*keys).agg(
        F.min(F.struct((-F.col(weight)).alias("w"), F.col(node).alias("n"))).alias("best")
    )
    chosen = best.select(*keys, F.col("best.n").alias(node))
    return links.filter(~has_face).unionByName(
        links.filter(has_face).join(chosen, [*keys, node], "left_semi")
    )


def _all_stars(pairs: DataFrame, graph: list[str]) -> bool:
    """True when every node hangs on one root and no root hangs on anything."""
    ends = pairs.select(
        *graph, F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("n"), F.lit(0).alias("hangs")))).alias("e")
    ).select(*graph, "e.*")
    roles = ends.groupBy(*graph, "n").agg(F.sum("hangs").alias("up"), F.min("hangs").alias("least"))
    return roles.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("least") == 0))).isEmpty()


def connected_components(edges: DataFrame, graph: list[str], max_rounds: int = 60) -> DataFrame:
    """Smallest node id of each node's component, by alternating star contraction.

    Each round hooks every node to the smallest id it can see; both halves aggregate per node
    with a map-side minimum. The edge set is cut to the checkpoint folder per round and the loop
    ends as soon as only stars are left.
    """
    pairs = edges.filter(F.col("src") != F.col("dst")).select(
        *graph, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()
    pairs = cut_lineage(pairs)
    rounds = 0
    while not _all_stars(pairs, graph):
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
        both = pairs.unionByName(pairs.select(*graph, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*graph, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (
            both.filter("v > u")
            .join(low, [*graph, "u"])
            .select(*graph, F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        large = cut_lineage(large)
        below = large.groupBy(*graph, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(below, [*graph, "u"])
            .select(*graph, F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        pairs = cut_lineage(small)
    roots = pairs.select(*graph, F.col("v").alias("u"), "v").distinct()
    return pairs.unionByName(roots).select(*graph, F.col("u").alias("node_id"), F.col("v").alias("root"))


def number_groups(
    members: DataFrame, graph: list[str], group: str, chunk_width: int, name: str
) -> DataFrame:
    """Number groups from zero by their smallest member id."""
    roots = members.select(*graph, F.col(group)).distinct()
    chunk = carry.chunk_if_hot(roots, graph, F.floor(F.col(group) / chunk_width))
    placed = carry.position(roots, graph, [group], chunk, name)
    return members.join(placed.withColumn(name, F.col(name) - 1), [*graph, group])


def characters(nodes: DataFrame, equal: DataFrame, graph: list[str], chunk_width: int = 65536) -> DataFrame:
    """Character number of every face and voice node; unlinked nodes are characters of their own."""
    found = connected_components(equal, graph)
    people = nodes.filter(F.col("type").isin("img", "voice")).select(*graph, "node_id", "type")
    rooted = people.join(found, [*graph, "node_id"], "left").withColumn("root", F.coalesce("root", "node_id"))
    return number_groups(rooted, graph, "root", chunk_width, "character")


def verified_links(
    links: DataFrame, vectors: DataFrame, graph: list[str], floor: float
) -> DataFrame:
    """Mark links whose two nodes' mean pairwise cosine reaches ``floor``."""
    unit = vectors.withColumn("vector", V.normalize(F.col("vector")))
    means = scoring.centroid(unit, [*graph, "node_id"], "vector", "mean")
    for end in ("src", "dst"):
        links = links.join(means.withColumnsRenamed({"node_id": end, "mean": f"{end}_mean"}), [*graph, end])
    score = F.round(V.dot(F.col("src_mean"), F.col("dst_mean")), V.SCORE_DIGITS)
    return links.withColumn("accepted", score >= floor).drop("src_mean", "dst_mean")


def one_to_one(candidates: DataFrame, keys: list[str], left: str, right: str, order: list[Column], tie: str) -> DataFrame:
    """Greedy one-to-one matching in the given order.

    A candidate that comes first for both of its ends is in the greedy result, whatever else
    happens; such candidates are taken all at once, their ends removed, and the rest repeated.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(tie).alias("tie"))
    left_over = cut_lineage(candidates.withColumn("__rank", rank))
    chosen = None
    while True:
        best_left = left_over.groupBy(*keys, left).agg(F.min("__rank").alias("bl"))
        best_right = left_over.groupBy(*keys, right).agg(F.min("__rank").alias("br"))
        marked = left_over.join(best_left, [*keys, left]).join(best_right, [*keys, right])
        taken = cut_lineage(marked.filter((F.col("__rank") == F.col("bl")) & (F.col("__rank") == F.col("br"))).drop("bl", "br"))
        chosen = taken if chosen is None else chosen.unionByName(taken)
        left_over = cut_lineage(
            left_over.join(taken.select(*keys, left), [*keys, left], "left_anti").join(
                taken.select(*keys, right), [*keys, right], "left_anti"
            )
        )
        if left_over.isEmpty():
            return chosen.drop("__rank")


def _forest(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple]:
    """Spanning forest of the given index pairs."""
    parent = list(range(len(ids)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for a, b in zip(left.tolist(), right.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
            out.append((ids[a], ids[b]))
    return out


def block_pairs(rows: DataFrame, keys: list[str], threshold: float, block_rows: int, extra: list[str]) -> DataFrame:
    """Deal unit vectors into blocks and name every two blocks between which a cosine >= ``threshold`` is possible.

    ``rows`` holds keys, id, v and ``extra`` columns. A block is one dominant axis direction,
    hash-split to a bounded size. Two blocks meet only if the angle between their centres less
    their angular radii allows a match. The rows of a meeting share (b1, b2); ``side`` tells the blocks
    apart, and a block that meets itself has side 0 only.
    """
    axis = F.array_max(
        F.transform("v", lambda x, i: F.struct(F.abs(x).alias("a"), F.signum(x).alias("s"), i.alias("i")))
    )
    # a scope of one block is not cut; a larger one is cut along the axes, coarsely at first
    scopes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).alias("__blocks"))
    direction = F.xxhash64(axis["s"], axis["i"])
    coarse = F.pmod(direction, F.col("__blocks"))
    placed = rows.join(scopes, keys).withColumn(
        "axis", F.when(F.col("__blocks") < 64, coarse).otherwise(direction)
    )
    sizes = placed.groupBy(*keys, "axis").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    blocked = cut_lineage(
        placed.join(sizes, [*keys, "axis"]).select(
            *keys, F.xxhash64("axis", F.pmod(F.xxhash64("id"), "parts")).alias("block"), "id", "v", *extra
        )
    )
    centres = scoring.centroid(blocked, [*keys, "block"], "v", "c").withColumn("c", V.normalize(F.col("c")))

    def angle(cosine: Column) -> Column:
        return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))

    bounds = (
        blocked.join(centres, [*keys, "block"])
        .groupBy(*keys, "block", "c")
        .agg(F.max(angle(V.dot(F.col("v"), F.col("c")))).alias("r"))
    )
    other = bounds.withColumnsRenamed({"block": "block2", "c": "c2", "r": "r2"})
    reach = F.acos(F.lit(threshold)) + 1e-9
    meetings = bounds.join(other, keys).filter(
        (F.col("block") <= F.col("block2"))
        & (angle(V.dot(F.col("c"), F.col("c2"))) - F.col("r") - F.col("r2") <= reach)
    ).select(*keys, "block", "block2")
    shape = [*keys, F.col("block").alias("b1"), F.col("block2").alias("b2"), "id", "v", *extra]
    one = meetings.join(blocked, [*keys, "block"]).select(*shape, F.lit(0).alias("side"))
    two = (
        meetings.filter("block <> block2")
        .join(blocked.withColumnRenamed("block", "block2"), [*keys, "block2"])
        .select(*shape, F.lit(1).alias("side"))
    )
    return one.unionByName(two)


def _meet_blocks(
    rows: DataFrame,
    keys: list[str],
    threshold: float,
    block_rows: int,
    extra: list[str],
    decide: Callable,
    out: list[str],
) -> DataFrame:
    """Rows of ``out`` id columns that ``decide(left, right, ids, extras)`` returns for the matches of two blocks.

    Pairs as such never leave a meeting.
    """
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{o} {types['id']}" for o in out)])

    def meet(table: pa.Table) -> pa.Table:
        ids = np.asarray(table["id"].to_pylist())
        side = table["side"].to_numpy()
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(b) == 0:
            b = a
        i, j = np.nonzero(np.round(v[a] @ v[b].T, V.SCORE_DIGITS) >= threshold)
        left, right = a[i], b[j]
        keep = left != right
        found = decide(left[keep], right[keep], ids, {c: np.asarray(table[c].to_pylist()) for c in extra})
        cols = {k: pa.array([table[k][0].as_py()] * len(found), table.schema.field(k).type) for k in keys}
        kind = table.schema.field("id").type
        for n, name in enumerate(out):
            cols[name] = pa.array([f[n] for f in found], kind)
        return pa.table(cols)

    dealt = block_pairs(rows, keys, threshold, block_rows, extra)
    return dealt.groupBy(*keys, "b1", "b2").applyInArrow(meet, schema)


def similarity_forest(
    df: DataFrame, keys: list[str], node: str, vector: str, threshold: float, block_rows: int = 1024
) -> DataFrame:
    """Edges that connect exactly the nodes linked by cosine >= ``threshold``.

    Identical vectors collapse to their smallest id first; a meeting of two blocks emits a
    spanning forest of its matches.
    """
    rows = df.select(*keys, F.col(node).alias("id"), V.normalize(F.col(vector)).alias("v"))
    same = rows.groupBy(*keys, "v").agg(F.min("id").alias("rep"))
    copies = rows.join(same, [*keys, "v"]).filter("id <> rep").select(
        *keys, F.col("rep").alias("src"), F.col("id").alias("dst")
    )

    def forest(left, right, ids, extras):
        return _forest(ids, left, right)

    distinct = same.select(*keys, F.col("rep").alias("id"), "v")
    linked = _meet_blocks(distinct, keys, threshold, block_rows, [], forest, ["src", "dst"])
    return linked.unionByName(copies)


def without_near_copies(
    df: DataFrame, keys: list[str], node: str, vector: str, weight: str, threshold: float, block_rows: int = 1024
) -> DataFrame:
    """Rows without a similar row (cosine > ``threshold``) that is heavier, or as heavy and earlier.

    Of identical vectors only the best can survive, so they collapse before blocks meet.
    """
    rank = F.struct((-F.col(weight)).alias("w"), F.col(node).alias("n"))
    unit = df.withColumn("__v", V.normalize(F.col(vector)))
    best = unit.groupBy(*keys, "__v").agg(F.min(rank).alias("b"))
    rows = best.select(*keys, F.col("b.n").alias("id"), F.col("__v").alias("v"), (-F.col("b.w")).alias("w"))
    # strictly above the threshold at the digits scores are compared with
    above = threshold + 10.0**-V.SCORE_DIGITS

    def losers(left, right, ids, extras):
        w = extras["w"]
        lost = np.where((w[left] > w[right]) | ((w[left] == w[right]) & (ids[left] < ids[right])), right, left)
        return [(ids[k],) for k in np.unique(lost)]

    lost = _meet_blocks(rows, keys, above, block_rows, ["w"], losers, ["id"]).distinct()
    kept = rows.join(lost, [*keys, "id"], "left_anti").select(*keys, F.col("id").alias(node))
    return df.join(kept, [*keys, node], "left_semi")


def truncate_by_clip(
    nodes: DataFrame, edges: DataFrame, graph: list[str], clip: Column
) -> tuple[DataFrame, DataFrame]:
    """Drop every node after the last text node of the given clip; untouched if it has none."""
    at = nodes.filter(F.col("type").isin(TEXT_TYPES) & (F.col("clip_id") == clip))
    last = at.groupBy(*graph).agg(F.max("node_id").alias("__last"))
    kept = nodes.join(last, graph, "left").filter(F.col("__last").isNull() | (F.col("node_id") <= F.col("__last")))
    kept_edges = edges.join(last, graph, "left").filter(
        F.col("__last").isNull() | ((F.col("src") <= F.col("__last")) & (F.col("dst") <= F.col("__last")))
    )
    return kept.drop("__last"), kept_edges.drop("__last")


def prune_type(nodes: DataFrame, edges: DataFrame, graph: list[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """Drop all nodes of one type and their edges."""
    gone = nodes.filter(F.col("type") == kind).select(*graph, "node_id")
    kept_edges = edges
    for end in ("src", "dst"):
        kept_edges = kept_edges.join(gone.withColumnRenamed("node_id", end), [*graph, end], "left_anti")
    return nodes.filter(F.col("type") != kind), kept_edges


def speaker_bias(hits: DataFrame, keys: list[str], bias: float, hard: bool) -> DataFrame:
    """Raise rows of the asked-for speaker; with ``hard`` drop the others unless none is left."""
    scored = hits.withColumn(
        "score", F.when(F.col("hit"), F.col("score") * (1.0 + max(0.0, bias))).otherwise(F.col("score"))
    )
    if not hard:
        return scored
    some = hits.groupBy(*keys).agg(F.bool_or("hit").alias("__some"))
    return scored.join(some, keys).filter(F.col("hit") | ~F.col("__some")).drop("__some")
