"""Vector arithmetic on ARRAY columns as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliptide.functions.arrays import let

#: Norms at or below this value leave a vector unchanged.
NORM_FLOOR = 1e-12
#: Scores are rounded to this many digits before a comparison decides a rank.
SCORE_DIGITS = 9


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    """Dot product of two equally long arrays, summed in double precision."""
    products = F.zip_with(as_doubles(left), as_doubles(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), lambda total, x: total + x * x))


def normalize(vector: Column) -> Column:
    """L2-normalise; a (near) zero vector is returned as it is.

    Vector and length are bound once: a lambda body is evaluated per element, and an inlined
    norm would make this quadratic.
    """
    return let(
        as_doubles(vector),
        lambda v: let(
            norm(v),
            lambda n: F.when(n <= NORM_FLOOR, v).otherwise(F.transform(v, lambda x: x / n)),
        ),
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; zero when a side is empty, null or has no length."""
    def ratio(p: Column) -> Column:
        def divide(n: Column) -> Column:
            usable = (F.size(p["l"]) > 0) & (n["l"] > NORM_FLOOR) & (n["r"] > NORM_FLOOR)
            return F.when(usable, dot(p["l"], p["r"]) / (n["l"] * n["r"]))

        return let(F.struct(norm(p["l"]).alias("l"), norm(p["r"]).alias("r")), divide)

    sides = F.struct(as_doubles(left).alias("l"), as_doubles(right).alias("r"))
    return F.coalesce(let(sides, ratio), F.lit(0.0))


def confidence(similarity: Column) -> Column:
    """Map a cosine to a confidence in [0, 1], four digits."""
    return F.round(F.least(F.greatest((similarity + 1) / 2, F.lit(0.0)), F.lit(1.0)), 4)


def mean_pool(vectors: Column) -> Column:
    """Mean direction of a list of vectors (the scale drops out); null for an empty list."""
    first = F.element_at(vectors, 1)
    total = F.aggregate(
        vectors,
        F.transform(as_doubles(first), lambda x: F.lit(0.0)),
        lambda acc, v: F.zip_with(acc, as_doubles(v), lambda x, y: x + y),
    )
    return F.when(F.size(vectors) > 0, normalize(total))


def minmax(value: Column, low: Column, high: Column, degenerate: float = 0.0) -> Column:
    """Scale into [0, 1]; an all-equal pool gets ``degenerate`` everywhere."""
    if degenerate == 0.0:
        return (value - low) / F.greatest(high - low, F.lit(1e-12))
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(float(degenerate)))
