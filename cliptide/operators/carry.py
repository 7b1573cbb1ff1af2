"""Running aggregates over ordered rows of keys of any size.

A window partitioned by a key alone sorts a hot key in one task. Here a key's rows are cut into
chunks by a deterministic expression of the order column (an hour of time, a block of
positions, a score band); rows are windowed per (key, chunk), each chunk is summarised with a
map-side aggregate, and only the chunk summaries are windowed per key.

``chunk_if_hot`` counts rows per key first: if every key fits one task comfortably it returns
None and plain windows are used, which then share one shuffle and sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliptide.session import cut_lineage

_CHUNK = "__chunk"

#: Keys with more rows than this are windowed in chunks.
HOT_ROWS = 1_000_000


def chunk_if_hot(df: DataFrame, keys: list[str], chunk: Column, hot_rows: int | None = None) -> Column | None:
    """``chunk`` if some key has more than ``hot_rows`` rows (or there is no key), else None."""
    if not keys:
        return chunk
    most = HOT_ROWS if hot_rows is None else hot_rows
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return None if counts.filter(F.col("n") > most).isEmpty() else chunk


@dataclass(frozen=True)
class Running:
    """``kind`` is sum, count, min, max or last (last non-null value)."""

    kind: str
    value: Column
    inclusive: bool = True


def _window_value(kind: str, value: Column) -> Column:
    build = {
        "sum": F.sum,
        "count": F.count,
        "min": F.min,
        "max": F.max,
        "last": lambda c: F.last(c, ignorenulls=True),
    }
    return build[kind](value)


def _combine(kind: str, local: Column, carried: Column) -> Column:
    if kind in {"sum", "count"}:
        both = F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        return both if kind == "count" else F.when(local.isNotNull() | carried.isNotNull(), both)
    if kind == "min":
        return F.least(local, carried)
    if kind == "max":
        return F.greatest(local, carried)
    return F.coalesce(local, carried)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column | None,
    specs: dict[str, Running],
    descending: bool = False,
) -> DataFrame:
    """Add one running column per spec, in ascending (or descending) ``order``.

    ``chunk`` must not decrease along ``order``; None asks for plain windows per key. The order
    columns must identify a row of a key.
    """
    direction = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    if chunk is None:
        whole = Window.partitionBy(*keys).orderBy(*[direction(c) for c in order])
        return df.withColumns(
            {
                name: _window_value(s.kind, s.value).over(
                    whole.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
                )
                for name, s in specs.items()
            }
        )
    rows = df.withColumn(_CHUNK, chunk)
    within = Window.partitionBy(*keys, _CHUNK).orderBy(*[direction(c) for c in order])
    local = rows
    for name, spec in specs.items():
        frame = within.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
        local = local.withColumn(name, _window_value(spec.kind, spec.value).over(frame))

    place = F.struct(*order)
    pick = F.min_by if descending else F.max_by
    totals = {
        name: (
            pick(spec.value, F.when(spec.value.isNotNull(), place))
            if spec.kind == "last"
            else _window_value(spec.kind, spec.value)
        )
        for name, spec in specs.items()
    }
    chunks = rows.groupBy(*keys, _CHUNK).agg(*[c.alias(f"__{n}") for n, c in totals.items()])
    before = (
        Window.partitionBy(*keys)
        .orderBy(direction(_CHUNK))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    merged = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    carried = chunks.select(
        *keys,
        _CHUNK,
        *[
            (
                F.last(f"__{n}", ignorenulls=True) if s.kind == "last" else merged[s.kind](f"__{n}")
            ).over(before).alias(f"__{n}")
            for n, s in specs.items()
        ],
    )
    joined = local.join(carried, [*keys, _CHUNK], "left")
    for name, spec in specs.items():
        joined = joined.withColumn(name, _combine(spec.kind, F.col(name), F.col(f"__{name}")))
    return joined.drop(_CHUNK, *[f"__{n}" for n in specs])


def settled(df: DataFrame, chunk: Column | None) -> DataFrame:
    """Between two chunked passes: store the rows, because a chunked pass reads its input twice."""
    return df if chunk is None else cut_lineage(df)


def position(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, name: str) -> DataFrame:
    """1-based row position per key."""
    return running(df, keys, order, chunk, {name: Running("count", F.lit(1))})


def islands(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    tie: str,
    chunk: Column | None,
    limit: Column | int,
    strict: bool = False,
) -> DataFrame:
    """Number the islands of intervals ordered by start.

    A row opens an island when it starts more than ``limit`` after everything before it ended
    (at least ``limit`` with ``strict``).
    """
    reach = {"__reach": Running("max", F.col(end), inclusive=False)}
    seen = running(df, keys, [start, tie], chunk, reach)
    gap = F.col(start) - F.col("__reach")
    opens = F.col("__reach").isNull() | ((gap >= limit) if strict else (gap > limit))
    flagged = settled(seen.withColumn("__opens", F.when(opens, 1).otherwise(0)), chunk)
    numbered = running(flagged, keys, [start, tie], chunk, {"island": Running("sum", F.col("__opens"))})
    return numbered.drop("__reach", "__opens")
