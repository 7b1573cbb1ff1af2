"""Clock strings, clip labels and chunk grids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of a caption clip in seconds.
CLIP_SECONDS = 30


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; zone-less timestamps count as UTC (the session zone)."""
    return F.unix_micros(ts.cast("timestamp"))


def parse_seconds(text: Column) -> Column:
    """``h:m:s`` with comma or dot decimals, or a plain number; anything else is null."""
    clean = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), ",", ".")
    parts = F.split(clean, ":")
    plain = F.when(clean.rlike("^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"), clean)
    clock = (
        F.get(parts, 0).try_cast("int") * 3600
        + F.get(parts, 1).try_cast("int") * 60
        + F.get(parts, 2).try_cast("double")
    )
    return F.when(~clean.contains(":"), plain.try_cast("double")).when(F.size(parts) == 3, clock)


def _clock(total: Column) -> Column:
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(total / 3600).cast("bigint"),
        F.floor((total % 3600) / 60).cast("bigint"),
        (total % 60).cast("bigint"),
    )


def format_seconds(seconds: Column) -> Column:
    """``HH:MM:SS`` rounded half to even, never negative; null gives an empty string."""
    whole = F.greatest(F.bround(seconds, 0).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(seconds.isNull(), F.lit("")).otherwise(_clock(whole))


def time_range(start: Column, end: Column, fallback: Column | None = None) -> Column:
    missing = start.isNull() | end.isNull()
    other = fallback if fallback is not None else F.lit("")
    return F.when(missing, other).otherwise(
        F.concat(format_seconds(start), F.lit(" --> "), format_seconds(end))
    )


def clip_label(ordinal: Column, length: int = CLIP_SECONDS) -> Column:
    """Time label of the n-th fixed-length clip, counted from zero."""
    begin = ordinal.cast("bigint") * length
    return F.concat(_clock(begin), F.lit(" --> "), _clock(begin + length))


def parse_mmss(text: Column) -> Column:
    parts = F.split(text, ":")
    return F.when(
        F.size(parts) == 2, F.get(parts, 0).try_cast("int") * 60 + F.get(parts, 1).try_cast("int")
    )


def format_mmss(seconds: Column, rounding: str = "floor") -> Column:
    cut = F.floor if rounding == "floor" else F.ceil
    total = F.greatest(cut(seconds).cast("bigint"), F.lit(0).cast("bigint"))
    return F.format_string("%02d:%02d", F.floor(total / 60).cast("bigint"), (total % 60).cast("bigint"))


def clock_to_ms(text: Column) -> Column:
    """``MM:SS`` or ``HH:MM:SS`` in milliseconds, zero when unreadable."""
    parts = F.split(F.coalesce(text, F.lit("")), ":")
    n = [F.get(parts, i).try_cast("int") for i in range(3)]
    value = F.when(F.size(parts) == 2, n[0] * 60 + n[1]).when(
        F.size(parts) == 3, n[0] * 3600 + n[1] * 60 + n[2]
    )
    return F.coalesce(value.cast("bigint") * 1000, F.lit(0).cast("bigint"))


def valid_segment(start: Column, end: Column, length: Column) -> Column:
    """True for ``MM:SS`` bounds with seconds below sixty, start before end, inside the audio."""
    def seconds(t: Column) -> Column:
        return F.get(F.split(t, ":"), 1).try_cast("int")

    low, high = parse_mmss(start), parse_mmss(end)
    inside = (seconds(start) < 60) & (seconds(end) < 60) & (low >= 0) & (low < high) & (high <= length)
    return F.coalesce(inside, F.lit(False))


def overlapping_chunks(start: Column, end: Column, length: Column, step: Column) -> Column:
    """Chunks of ``length`` every ``step`` (whole units); the last one is cut at ``end``."""
    # a chunk starts while start + length < end + step
    last = end + step - length - 1
    begins = F.when(last >= start, F.sequence(start, last, step)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(
        begins, lambda b: F.struct(b.alias("start"), F.least(b + length, end).alias("end"))
    )
