"""Small statistics over ARRAY<DOUBLE> columns, as built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def positions(low: Column | int, high: Column | int) -> Column:
    """``low..high`` as an array, empty when ``high < low``."""
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return F.when(high >= low, F.sequence(low.cast("int"), high.cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def at(values: Column, index: Column | int) -> Column:
    """1-based element, null outside the array."""
    index = F.lit(index) if isinstance(index, int) else index
    return F.when((index >= 1) & (index <= F.size(values)), F.get(values, index - 1))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values)).otherwise(F.lit(0.0))


def squared_error(values: Column) -> Column:
    """Sum of squared distances to the mean."""
    return let(mean(values), lambda m: total(F.transform(values, lambda x: (x - m) * (x - m))))


def std(values: Column) -> Column:
    """Population standard deviation, zero for an empty array."""
    spread = F.sqrt(squared_error(values) / F.size(values))
    return F.when(F.size(values) > 0, spread).otherwise(F.lit(0.0))


def quantile(values: Column, q: float) -> Column:
    """Linearly interpolated quantile, zero for an empty array."""

    def pick(ordered: Column) -> Column:
        place = (F.size(ordered) - 1) * F.lit(float(q))
        low, high = F.floor(place), F.ceil(place)
        below, above = F.get(ordered, low.cast("int")), F.get(ordered, high.cast("int"))
        return below + (above - below) * (place - low)

    return F.when(F.size(values) > 0, let(F.array_sort(values), pick)).otherwise(F.lit(0.0))


def median(values: Column) -> Column:
    return quantile(values, 0.5)


def robust_spread(values: Column, centre: Column) -> Column:
    """1.4826 * MAD around ``centre``; the standard deviation when the MAD vanishes."""
    mad = median(F.transform(values, lambda x: F.abs(x - centre)))
    return let(mad * 1.4826, lambda s: F.when(s <= 1e-8, std(values)).otherwise(s))


def running_min(values: Column) -> Column:
    """Monotone (non-increasing) smoothing."""
    return F.transform(positions(1, F.size(values)), lambda i: F.array_min(F.slice(values, 1, i)))


def running_sum(values: Column) -> Column:
    return F.transform(positions(1, F.size(values)), lambda i: total(F.slice(values, 1, i)))


def scaled(values: Column, floor: float = 1e-6) -> Column:
    """Min-max scale a curve, the range being at least ``floor``."""
    low, high = F.array_min(values), F.array_max(values)
    return let(
        F.struct(low.alias("low"), F.greatest(high - low, F.lit(floor)).alias("range")),
        lambda b: F.transform(values, lambda x: (x - b["low"]) / b["range"]),
    )


def adjacent_drops(values: Column) -> Column:
    """``max(0, v[i] - v[i+1])`` for each adjacent pair."""
    return F.transform(
        positions(1, F.size(values) - 1),
        lambda i: F.greatest(F.lit(0.0), F.get(values, i - 1) - F.get(values, i)),
    )


def relative_drops(values: Column, floor: float = 1e-6) -> Column:
    """Adjacent drop divided by the magnitude of the left value."""
    return F.transform(
        positions(1, F.size(values) - 1),
        lambda i: F.greatest(F.lit(0.0), F.get(values, i - 1) - F.get(values, i))
        / F.greatest(F.abs(F.get(values, i - 1)), F.lit(floor)),
    )


def first_index(values: Column, test: Callable[[Column], Column]) -> Column:
    """1-based position of the first element passing ``test``, null if none."""
    hits = F.filter(positions(1, F.size(values)), lambda i: test(F.get(values, i - 1)))
    return F.get(hits, F.lit(0))


def best_index(values: Column) -> Column:
    """1-based position of the largest element, the first one on ties."""
    keyed = F.transform(positions(1, F.size(values)), lambda i: F.struct(F.get(values, i - 1), -i))
    return -F.array_max(keyed)["col2"]


def erf(x: Column, terms: int = 120) -> Column:
    """Error function by its all-positive series; saturates beyond five."""
    size = F.abs(x)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(size.alias("term"), size.alias("sum")),
        lambda acc, n: F.struct(
            (acc["term"] * 2.0 * size * size / (2 * n + 1)).alias("term"),
            (acc["sum"] + acc["term"] * 2.0 * size * size / (2 * n + 1)).alias("sum"),
        ),
        lambda acc: acc["sum"] * F.exp(-size * size) * 1.1283791670955126,
    )
    return F.signum(x) * F.when(size >= 5.0, F.lit(1.0)).otherwise(series)
