"""Ordered clip streams with keyed state.

Clips of one key must arrive in order; rows of one micro-batch are sorted before use. State holds
only what the next clip needs (a partial window, the last few values, node summaries).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cliptide.session import ensure_checkpoint_dir
from cliptide.streaming import ordered


def run_available(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a stream over everything available and read its result back.

    Output and progress go to the shared checkpoint folder, so a restarted query resumes.
    """
    ensure_checkpoint_dir(spark)
    base = os.path.join(str(spark.sparkContext.getCheckpointDir()), f"{name}-{uuid.uuid4().hex}")
    writer = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/data")
        .option("checkpointLocation", f"{base}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .queryName(f"{name}_{uuid.uuid4().hex[:8]}")
    )
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def scene_stream(clips: DataFrame, key: str, clip: str, text: str, last: str, size: int = 6) -> DataFrame:
    """Tumbling windows of ``size`` clips, whatever order they arrive in; the clip marked ``last`` flushes the remainder.

    Windows without text emit nothing.
    """
    done = ordered.in_order(clips, key, clip, [text, last], ordered.SceneFold(text, clip, last, size))
    made = ordered.results(done, key, "scene bigint, last_clip bigint, clips bigint, members array<bigint>, fragments bigint")
    return made.drop("clip")


def resolve_entities(
    rows: DataFrame, key: str, order: str, vector: str, threshold: float, cap: int = 20
) -> DataFrame:
    """Online entity resolution: each vector joins the most similar node or opens a new one.

    Similarity is the mean cosine to the node's kept vectors, so per node a sum of unit vectors
    and a count are enough; the first ``cap`` vectors of a node are kept.
    """
    types = dict(rows.dtypes)
    out = f"{key} {types[key]}, {order} {types[order]}, node bigint"
    state = "sums array<array<double>>, counts array<bigint>"

    def step(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        sums, counts = held.get if held.exists else ([], [])
        sums = [np.asarray(s, dtype=float) for s in sums]
        counts = list(counts)
        made = []
        pdf = pd.concat(list(batches)).sort_values(order)
        for at, raw in pdf[[order, vector]].itertuples(index=False):
            v = np.asarray(raw, dtype=float)
            length = np.linalg.norm(v)
            v = v / length if length > 1e-12 else v
            node = -1
            if sums:
                scores = np.round(np.stack(sums) @ v / np.asarray(counts), 9)
                best = int(np.argmax(scores))
                node = best if scores[best] >= threshold else -1
            if node < 0:
                sums.append(v)
                counts.append(1)
                node = len(sums) - 1
            elif counts[node] < cap:
                sums[node] = sums[node] + v
                counts[node] += 1
            made.append((keys[0], at, node))
        held.update(([s.tolist() for s in sums], counts))
        yield pd.DataFrame(made, columns=[key, order, "node"])

    return rows.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def upsert_memories(
    rows: DataFrame, key: str, order: str, entities: str, vector: str, same: float = 0.85, opposite: float = 0.0
) -> DataFrame:
    """Insert semantic memories, or reinforce / weaken the ones they repeat or contradict.

    Compared are the kept memories of the first entity that know all entities of the new one. All
    edges of a memory move together (by two per vote, from one), so one weight per memory is
    enough; at zero or below its edges are gone and it is no longer found.
    """
    types = dict(rows.dtypes)
    out = f"{key} {types[key]}, {order} {types[order]}, action string, nodes array<bigint>"
    state = "entities array<array<string>>, vectors array<array<double>>, weights array<double>"

    def step(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        known, vectors, weights = held.get if held.exists else ([], [], [])
        known = [list(k) for k in known]
        vectors = [list(v) for v in vectors]
        weights = list(weights)
        made = []
        pdf = pd.concat(list(batches)).sort_values(order)
        for at, tags, raw in pdf[[order, entities, vector]].itertuples(index=False):
            tags = list(tags) if tags is not None else []
            v = np.asarray(raw, dtype=float)
            v = v / max(np.linalg.norm(v), 1e-12)
            votes = {}
            for node, theirs in enumerate(known):
                if tags and weights[node] > 0 and set(tags) <= set(theirs):
                    sim = round(float(np.asarray(vectors[node]) @ v), 9)
                    if sim > same:
                        votes[node] = 2.0
                    elif sim < opposite:
                        votes[node] = -2.0
            for node, change in votes.items():
                weights[node] += change
            if votes:
                action = "reinforce" if max(votes.values()) > 0 else "weaken"
                made.append((keys[0], at, action, sorted(votes)))
            else:
                known.append(tags)
                vectors.append(v.tolist())
                weights.append(1.0)
                made.append((keys[0], at, "new", [len(known) - 1]))
        held.update((known, vectors, weights))
        yield pd.DataFrame(made, columns=[key, order, "action", "nodes"])

    return rows.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)
