"""The memory graph built from batches of observations: ids, kept embeddings, contents and edges as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.operators import carry, graph, scoring
from cliptide.session import cut_lineage

#: Embeddings that a face and a voice keep at most.
KEPT_EMBEDDINGS = {"img": 10, "voice": 20}
#: Clips that share a chunk when the nodes of a hot graph are numbered.
CHUNK_CLIPS = 16


def node_key() -> Column:
    """What makes observations one node: a face's or voice's entity; a text is a node of its own."""
    own = F.concat_ws(":", F.col("type"), F.col("clip_id").cast("string"), F.col("seq").cast("string"))
    return F.when(F.col("type").isin(graph.TEXT_TYPES), own).otherwise(F.concat_ws(":", "type", "entity"))


def graph_nodes(observations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_key, node_id, type, clip_id, contents): nodes numbered from zero by first observation.

    ``observations``: keys, type, entity, clip_id, seq, content. ``clip_id`` and ``seq`` order the observations of a graph,
    whatever batch they come in, so a later batch adds ids after those of an earlier one and changes none.
    """
    first = observations.groupBy(*keys, node_key().alias("node_key"), "type").agg(
        F.min(F.struct("clip_id", "seq")).alias("__first"), F.count("content").alias("contents")
    )
    placed = first.select(*keys, "node_key", "type", "contents", F.col("__first.clip_id").alias("clip_id"), F.col("__first.seq").alias("seq"))
    placed = cut_lineage(placed)
    chunk = carry.chunk_if_hot(placed, keys, F.floor(F.col("clip_id") / CHUNK_CLIPS))
    ids = carry.position(placed, keys, ["clip_id", "seq", "node_key"], chunk, "node_id")
    return ids.withColumn("node_id", F.col("node_id") - 1).drop("seq")


def kept_embeddings(observations: DataFrame, nodes: DataFrame, keys: list[str], caps: dict[str, int] | None = None) -> DataFrame:
    """(keys, node_id, slot, clip_id, seq, embedding): all embeddings of texts, and a fixed sample of each face and voice.

    The sample holds the rows with the smallest digests of (node, clip, place). Every observation has the same
    chance, samples of parts merge into the sample of the whole, and only ``cap`` rows per node and task are sent.
    """
    caps = KEPT_EMBEDDINGS if caps is None else caps
    cap = F.lit(None).cast("int")
    for kind, most in caps.items():
        cap = F.when(F.col("type") == kind, most).otherwise(cap)
    digest = F.md5(F.concat_ws("|", "node_key", F.col("clip_id").cast("string"), F.col("seq").cast("string")))
    rows = observations.filter(F.col("embedding").isNotNull()).select(
        *keys, "type", node_key().alias("node_key"), "clip_id", "seq", "embedding"
    ).withColumn("__digest", digest)
    order = [F.col("__digest"), F.col("clip_id"), F.col("seq")]
    sampled = scoring.top_k(rows.filter(cap.isNotNull()), [*keys, "node_key"], order, max(caps.values(), default=0), "slot")
    every = scoring.top_k(rows.filter(cap.isNull()), [*keys, "node_key"], order, 1, "slot")
    kept = sampled.filter(F.col("slot") <= cap).unionByName(every)
    return kept.join(nodes.select(*keys, "node_key", "node_id"), [*keys, "node_key"]).select(
        *keys, "node_id", "slot", "clip_id", "seq", "embedding"
    )


def node_contents(observations: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id, clip_id, seq, content) of every observation with content; in the order of clip and place it is the node's list."""
    rows = observations.filter(F.col("content").isNotNull()).select(*keys, node_key().alias("node_key"), "clip_id", "seq", "content")
    return rows.join(nodes.select(*keys, "node_key", "node_id"), [*keys, "node_key"]).drop("node_key")


def graph_edges(links: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, weight), both directions, of statements (keys, one, two, weight, clip_id, seq) about node keys.

    A later statement about the same two nodes replaces an earlier one. Statements about unknown nodes, a node
    and itself, or two texts of one type are left out.
    """
    ends = nodes.select(*keys, "node_key", "node_id")
    found = links
    for name, new in (("one", "src"), ("two", "dst")):
        found = found.join(ends.withColumnsRenamed({"node_key": name, "node_id": new}), [*keys, name])
    low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    last = found.filter("src <> dst").groupBy(*keys, low, high).agg(F.max(F.struct("clip_id", "seq", "weight")).alias("__last"))
    valid = graph.valid_edges(last.select(*keys, "src", "dst", F.col("__last.weight").alias("weight")), nodes, keys)
    return graph.undirected(valid)
