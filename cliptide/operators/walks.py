"""Routes through texts that share entities: many walks at once, one row per walk and step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.operators import carry
from cliptide.session import broadcast_when_small, cut_lineage

#: Ids that share a chunk when the neighbours of a hub are numbered.
CHUNK_IDS = 4096


def draw(*parts: Column) -> Column:
    """A number below 2**32 that depends on the parts only; remainders choose among rows, so a rerun walks alike."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def numbered_neighbours(edges: DataFrame, keys: list[str], node: str, other: str) -> tuple[DataFrame, DataFrame]:
    """(keys, node, place, other) with places from zero in the order of ``other``, and (keys, node, degree).

    A neighbour is then found by an equality on node and place, so the rows of a hub are spread.
    """
    pairs = cut_lineage(edges.select(*keys, node, other).distinct())
    chunk = carry.chunk_if_hot(pairs, [*keys, node], F.floor(F.col(other) / CHUNK_IDS))
    placed = carry.position(pairs, [*keys, node], [other], chunk, "place").withColumn("place", F.col("place") - 1)
    return cut_lineage(placed), cut_lineage(pairs.groupBy(*keys, node).agg(F.count("*").alias("degree")))


def route_walks(edges: DataFrame, keys: list[str], walks: DataFrame, length: int = 3) -> DataFrame:
    """(keys, walk, route) of each of ``walks`` (keys, walk) over ``edges`` (keys, text, entity).

    A route starts at any text. Each step takes any text of the route, any entity of that, and any text of the
    entity that is not in the route yet; if there is none, the route stays. All choices are ``draw``s of walk and step.
    """
    of_text, text_degree = numbered_neighbours(edges, keys, "text", "entity")
    of_entity, entity_degree = numbered_neighbours(edges, keys, "entity", "text")
    texts, chunk = edges.select(*keys, "text").distinct(), F.floor(F.col("text") / CHUNK_IDS)
    starts = carry.position(texts, keys, ["text"], carry.chunk_if_hot(texts, keys, chunk), "place")
    counts = texts.groupBy(*keys).agg(F.count("*").alias("texts"))
    # a shuffle by the keys would send all walks of a graph to one task
    begun = walks.join(broadcast_when_small(cut_lineage(counts), 100), keys).withColumn("place", draw(F.col("walk"), F.lit(0), F.lit("text")) % F.col("texts") + 1)
    state = cut_lineage(begun.join(starts, [*keys, "place"]).select(*keys, "walk", F.array("text").alias("route")))
    for step in range(1, length):
        turn = F.lit(step)
        anchor = F.get("route", (draw(F.col("walk"), turn, F.lit("text")) % F.size("route")).cast("int"))
        at = state.withColumn("text", anchor).join(text_degree, [*keys, "text"])
        at = at.withColumn("place", draw(F.col("walk"), turn, F.lit("entity")) % F.col("degree")).drop("degree")
        at = cut_lineage(at.join(of_text, [*keys, "text", "place"]).drop("text", "place").join(entity_degree, [*keys, "entity"]))
        # places of the route's own texts among the entity's, at most one per step so far
        own = at.select(*keys, "walk", "entity", F.explode("route").alias("text")).join(of_entity, [*keys, "entity", "text"])
        own = own.groupBy(*keys, "walk").agg(F.sort_array(F.collect_list("place")).alias("own"))
        left = at.join(own, [*keys, "walk"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<bigint>")))
        free = F.col("degree") - F.size("own")
        first = F.when(free > 0, draw(F.col("walk"), turn, F.lit("next")) % free)
        place = F.aggregate("own", first, lambda at_, own_: F.when(at_ >= own_, at_ + 1).otherwise(at_))
        chosen = left.withColumn("place", place).join(of_entity, [*keys, "entity", "place"], "left")
        grown = F.when(F.col("text").isNull(), F.col("route")).otherwise(F.concat("route", F.array("text")))
        state = cut_lineage(chosen.select(*keys, "walk", grown.alias("route")))
    return state
