"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: What a null id counts as inside an operator; results carry null again.
NO_ID = -(2**63)
#: Cells for each marked key, the most cells there are (32 MB of bits), and those that one group packs.
CELLS_EACH, MOST_CELLS, PACKED_CELLS = 32, 1 << 28, 1 << 19


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and go on from the files.

    Lost executors cost nothing that was written, and values that depend on the run, such as
    partition numbers, stay as they are.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_id() -> Column:
    """Integer id, null as ``NO_ID``."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def real_id(column: str = "id") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def tie() -> Column:
    """Digest that tells texts under one id apart; null counts as empty."""
    return F.xxhash64(text_or_empty())


def keyed(docs: DataFrame) -> DataFrame:
    """(id, tie, text): rows with equal ids and texts are one document, other texts under an id are others."""
    return docs.select(doc_id().alias("id"), tie().alias("tie"), text_or_empty().alias("text"))


def remainder(parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def positioned(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """Add ``pos``, the place of each row in the given order, from 0; ``sums`` adds running sums.

    Rows are dealt by range, so no task sees more than its range, whatever the keys; only one row
    per partition goes through the window that adds up the ranges. ``sums`` maps a new column to
    the column whose values up to and with the row it adds up.
    """
    sums = sums or {}
    ranged = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    )
    part, index = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    parts = ranged.groupBy(part.alias("__part")).agg(
        F.count("*").alias("__n"), *[F.sum(c).alias(f"__{new}") for new, c in sums.items()]
    )
    starts = parts.select(
        "__part",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        *[F.coalesce(F.sum(f"__{new}").over(before), F.lit(0)).alias(f"__{new}") for new in sums],
    )
    placed = ranged.withColumn("__part", part)
    for new, column in sums.items():
        placed = placed.withColumn(new, F.sum(column).over(inner))
    placed = placed.join(F.broadcast(starts), "__part").withColumn("pos", F.col("__start") + index)
    for new in sums:
        placed = placed.withColumn(new, F.col(new) + F.col(f"__{new}"))
    return placed.drop("__at", "__part", "__start", *[f"__{new}" for new in sums])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) of every id in ``edges`` (src, dst): the smallest id that links reach.

    Rounds of minimum-label hooking with pointer jumps; each aggregates per node with a map-side
    minimum, is written to the shared folder, and the loop ends when no label changes.
    """
    pairs = written(
        edges.filter(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    )
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("far")).unionByName(
        pairs.select(F.col("b").alias("id"), F.col("a").alias("far"))
    )
    labels = written(both.groupBy("id").agg(F.least(F.min("far"), F.col("id")).alias("root")))
    for _ in range(max_rounds):
        # the smallest label beside each node, offered to the node and to its present root
        seen = both.join(labels.select(F.col("id").alias("far"), F.col("root").alias("beside")), "far").groupBy("id").agg(F.min("beside").alias("beside"))
        offers = labels.join(seen, "id").select("id", "root", F.least("root", "beside").alias("least"))
        hooked = (
            offers.select(F.explode(F.array("id", "root")).alias("id"), "least")
            .groupBy("id")
            .agg(F.min("least").alias("low"))
        )
        jumped = hooked.join(labels.select(F.col("id").alias("low"), F.col("root").alias("up")), "low", "left").select(
            "id", F.least("low", F.coalesce("up", "low")).alias("root")
        )
        new = written(jumped)
        changed = not new.join(labels.withColumnRenamed("root", "was"), "id").filter(F.col("root") != F.col("was")).isEmpty()
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes, single rows excepted, so that memory does not follow the batch size."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index("text"))
        ends = sizes.offset
        buffers = sizes.buffers()
        wide = pa.types.is_large_string(sizes.type) or pa.types.is_large_binary(sizes.type)
        marks = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[ends : ends + len(sizes) + 1] if len(sizes) else []
        start = 0
        while start < len(sizes):
            stop = int(np.searchsorted(marks, marks[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), len(sizes))
            yield batch.slice(start, stop - start)
            start = stop


def byte_texts(batch: pa.RecordBatch) -> list[bytes]:
    """UTF-8 of the text column, null as empty."""
    column = batch.column(batch.schema.get_field_index("text"))
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]


def marked_cells(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for the cell of each hash in ``column``, as bytes: ``in_cells`` holds for every marked hash, and seldom for others.

    Bits are put together by 64 in a map-side aggregate, then by block, so the driver gets one row per block.
    """
    cells = min(MOST_CELLS, max(PACKED_CELLS, 1 << (CELLS_EACH * keys.count()).bit_length()))
    cell = F.col(column).bitwiseAND(F.lit(cells - 1))
    words = keys.groupBy(F.shiftright(cell, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), cell.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    )

    def pack(key, rows):
        block = np.zeros(PACKED_CELLS // 64, np.int64)
        block[rows.column("word").to_numpy() % len(block)] = rows.column("bits").to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([block.tobytes()], pa.binary())})

    packed = words.withColumn("block", F.floor(F.col("word") / (PACKED_CELLS // 64))).groupBy("block").applyInArrow(pack, "block bigint, bits binary")
    bits = np.zeros((cells // PACKED_CELLS, PACKED_CELLS // 8), np.uint8)
    for row in packed.collect():
        bits[row.block] = np.frombuffer(row.bits, np.uint8)
    return bits.ravel()


def in_cells(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes & np.int64(8 * len(bits) - 1)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def where_marked(rows: DataFrame, column: str, bits: np.ndarray, inside: bool) -> DataFrame:
    """The rows whose hash in ``column`` is in a marked cell, or those whose hash is not."""
    shipped = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            yield batch.filter(pa.array(in_cells(shipped.value, batch.column(at).to_numpy()) == inside))

    return rows.mapInArrow(run, rows.schema)


LONG, DOUBLE, STRING = T.LongType(), T.DoubleType(), T.StringType()
