"""Names that resemble each other, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliptide.functions.arrays import let
from cliptide.operators.identity import person_name

#: Score of a name inside another, shortest such name, letters that must start both, and the least ratio.
CONTAINED, INSIDE_LETTERS, SHARED_START, LEAST_RATIO = 0.95, 3, 2, 0.45


def _longest_block(one: Column, two: Column) -> Column:
    """(size, at) of the longest stretch of ``one`` that stands in ``two``; of equally long ones the first."""

    def from_place(at: Column) -> Column:
        lengths = F.sequence(F.lit(1), F.length(one) - at + 1)
        fitting = F.filter(lengths, lambda n: F.contains(two, F.substring(one, at, n)))
        return F.struct(F.coalesce(F.array_max(fitting), F.lit(0)).alias("size"), (-at).alias("back"))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.length(one)), from_place))
    return F.struct(best["size"].alias("size"), (-best["back"]).alias("at"))


def block_ratio(left: Column, right: Column) -> Column:
    """Twice the letters in common blocks over all letters.

    The longest common stretch is a block, and so are in turn those of the parts before it and of the parts after it.
    Open parts stand in a list; each step of the fold settles one, and two letters' worth of steps are enough.
    """
    part = "array<struct<one: string, two: string>>"

    def parts(*pairs: tuple[Column, Column]) -> Column:
        made = F.array(*[F.struct(a.alias("one"), b.alias("two")) for a, b in pairs]).cast(part)
        return F.filter(made, lambda p: (F.length(p["one"]) > 0) & (F.length(p["two"]) > 0))

    def settle(state: Column, _: Column) -> Column:
        def with_block(block: Column) -> Column:
            one, two = F.get(state["open"], 0)["one"], F.get(state["open"], 0)["two"]
            at, size = block["at"], block["size"]
            there = F.instr(two, F.substring(one, at, size))
            new = parts(
                (F.substring(one, F.lit(1), at - 1), F.substring(two, F.lit(1), there - 1)),
                (F.substring(one, at + size, F.length(one)), F.substring(two, there + size, F.length(two))),
            )
            rest = F.slice(state["open"], F.lit(2), F.greatest(F.size(state["open"]) - 1, F.lit(0)))
            return F.struct(
                F.when(size > 0, F.concat(rest, new)).otherwise(rest).alias("open"), (state["same"] + size).cast("int").alias("same")
            )

        block = _longest_block(F.get(state["open"], 0)["one"], F.get(state["open"], 0)["two"])
        return F.when(F.size(state["open"]) == 0, state).otherwise(let(block, with_block))

    begun = F.struct(parts((left, right)).alias("open"), F.lit(0).alias("same"))
    steps = F.sequence(F.lit(0), 2 * F.length(left) + 1)
    same = F.aggregate(steps, begun, settle)["same"]
    letters = F.length(left) + F.length(right)
    return F.when(letters == 0, F.lit(1.0)).otherwise(2.0 * same / letters)


def name_similarity(left: Column, right: Column) -> Column:
    """1 for equal names, 0.95 for containment, else the block ratio if it is convincing."""
    a, b = person_name(left), person_name(right)
    inside = ((F.length(a) >= INSIDE_LETTERS) & F.contains(b, a)) | ((F.length(b) >= INSIDE_LETTERS) & F.contains(a, b))
    shared = (F.least(F.length(a), F.length(b)) >= SHARED_START) & (F.substring(a, 1, SHARED_START) == F.substring(b, 1, SHARED_START))
    ratio = F.when(shared, block_ratio(a, b))
    fuzzy = F.when(ratio >= LEAST_RATIO, ratio).otherwise(F.lit(0.0))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when(inside, F.lit(CONTAINED)).otherwise(fuzzy)
