"""Accuracy roll-ups, run summaries and paired tests over graded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.functions.arrays import let

ALL = "(all)"
NONE = "(none)"


def _rates(correct: str) -> list[Column]:
    hit = F.col(correct).cast("bigint")
    return [
        F.count("*").alias("total"),
        F.sum(hit).alias("correct"),
        F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"),
    ]


def accuracy(df: DataFrame, correct: str, selected: str | None = None) -> DataFrame:
    """Totals over all answers; a missing selected count counts as zero."""
    aggs = _rates(correct)
    if selected:
        aggs.append(F.coalesce(F.avg(F.coalesce(F.col(selected), F.lit(0))), F.lit(0.0)).alias("mean_selected"))
    return df.agg(*aggs).na.fill(0)


def rollup_levels(df: DataFrame, levels: list[list[str]], correct: str) -> DataFrame:
    """Accuracy at several grouping levels in one pass; rolled-up keys read ``(all)``."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    known = df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit(NONE)) for k in keys})
    grouped = known.groupingSets([[F.col(k) for k in level] for level in levels], *keys)
    out = grouped.agg(*_rates(correct))
    return out.withColumns({k: F.coalesce(k, F.lit(ALL)) for k in keys})


def by_types_and_video(
    df: DataFrame, types: str, video: str, correct: str, selected: str
) -> DataFrame:
    """Accuracy per (multi-valued) task type, per video and overall, as (level, name) rows."""
    row = df.withColumn("__types", F.when(F.size(types) > 0, F.col(types)).otherwise(F.array(F.lit(NONE))))
    tags = F.concat(
        F.transform("__types", lambda t: F.struct(F.lit("type").alias("level"), t.alias("name"))),
        F.array(
            F.struct(F.lit("video").alias("level"), F.coalesce(F.col(video).cast("string"), F.lit(NONE)).alias("name")),
            F.struct(F.lit("all").alias("level"), F.lit(ALL).alias("name")),
        ),
    )
    flat = row.select(F.explode(tags).alias("tag"), correct, selected)
    return (
        flat.groupBy(F.col("tag.level").alias("level"), F.col("tag.name").alias("name"))
        .agg(*_rates(correct), F.avg(selected).alias("mean_selected"))
    )


def substring_rollup(df: DataFrame, key_parts: list[str], names: list[str], correct: str) -> DataFrame:
    """Parity mode: a row counts for every name contained in its joined category key."""
    key = F.concat_ws("_", *key_parts)
    listed = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(key, n))
    return df.select(F.explode(listed).alias("name"), correct).groupBy("name").agg(*_rates(correct))


def per_subset_accuracy(df: DataFrame, subsets: list[str], correct: str) -> DataFrame:
    """Accuracy per value of each subset column; ``Overall`` counts a row once per column."""
    tags = F.array(*[F.col(c).cast("string") for c in subsets])
    flat = df.select(F.explode(tags).alias("name"), correct)
    return flat.groupingSets([[F.col("name")], []], "name").agg(*_rates(correct)).withColumn(
        "name", F.coalesce("name", F.lit("Overall"))
    )


def macro_accuracy(
    df: DataFrame, category: str, correct: str, fixed: list[str] | None = None, digits: int | None = None
) -> DataFrame:
    """Per-category percent, micro average and unweighted mean over the (fixed) categories.

    With ``fixed`` an absent category counts as zero; with ``digits`` the mean is taken over
    percentages already rounded.
    """
    counts = df.groupBy(F.col(category).alias("name")).agg(
        F.count("*").alias("total"), F.sum(F.col(correct).cast("bigint")).alias("correct")
    )
    if fixed is not None:
        wanted = df.sparkSession.createDataFrame([(n,) for n in fixed], "name string")
        counts = wanted.join(counts, "name", "left").na.fill(0)
    percent = F.coalesce(100.0 * F.col("correct") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    if digits is not None:
        percent = F.round(percent, digits)
    rows = counts.withColumn("percent", percent)
    micro = F.coalesce(100.0 * F.sum("correct") / F.nullif(F.sum("total"), F.lit(0)), F.lit(0.0))
    totals = rows.agg(
        F.sum("total").alias("total"),
        F.sum("correct").alias("correct"),
        micro.alias("micro"),
        F.avg("percent").alias("macro"),
    )
    spread = totals.select(
        F.explode(
            F.array(
                F.struct(F.lit("(micro)").alias("name"), "total", "correct", F.col("micro").alias("percent")),
                F.struct(F.lit("(macro)").alias("name"), "total", "correct", F.col("macro").alias("percent")),
            )
        ).alias("r")
    ).select("r.*")
    return rows.select("name", "total", "correct", "percent").unionByName(spread)


def discipline_scores(df: DataFrame, discipline: str, score: str, yes: str, forced: list[str]) -> DataFrame:
    """Mean score and yes-rate per forced discipline, and the mean of the discipline means."""
    wanted = df.sparkSession.createDataFrame([(n,) for n in forced], "name string")
    found = df.groupBy(F.col(discipline).alias("name")).agg(
        F.count("*").alias("total"),
        F.avg(score).alias("mean_score"),
        (F.avg(F.col(yes).cast("int")) * 100).alias("yes_rate"),
    )
    rows = wanted.join(found, "name", "left").na.fill(0)
    final = rows.agg(
        F.lit("(final)").alias("name"),
        F.sum("total").alias("total"),
        F.avg("mean_score").alias("mean_score"),
        F.avg("yes_rate").alias("yes_rate"),
    )
    return rows.unionByName(final)


def run_summary(df: DataFrame, run: str, k: str, selector: str, correct: str) -> DataFrame:
    """Per run: log count, mean depth, depth histogram, selector counts, accuracy in percent."""
    flat = df.select(
        run,
        F.explode(
            F.array(
                F.struct(F.lit("k").alias("kind"), F.col(k).cast("string").alias("name")),
                F.struct(F.lit("selector").alias("kind"), F.col(selector).cast("string").alias("name")),
            )
        ).alias("tag"),
    ).filter(F.col("tag.name").isNotNull())
    counted = flat.groupBy(run, "tag").agg(F.count("*").alias("n"))
    entry = F.struct(F.col("tag.name").alias("key"), F.col("n").alias("value"))
    maps = counted.groupBy(run).agg(
        *[
            F.map_from_entries(
                F.array_sort(F.collect_list(F.when(F.col("tag.kind") == kind, entry)))
            ).alias(name)
            for kind, name in (("k", "k_counts"), ("selector", "selectors"))
        ]
    )
    totals = df.groupBy(run).agg(
        F.count("*").alias("logs"),
        F.avg(k).alias("mean_k"),
        (100.0 * F.avg(F.col(correct).cast("int"))).alias("accuracy"),
    )
    return totals.join(maps, run)


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series, exact table values below 21."""
    x = n.cast("double")
    series = (
        x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    )
    small = F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))
    return F.when(n <= 20, small).otherwise(series)


def sign_test(win: Column, loss: Column) -> Column:
    """Exact two-sided sign test.

    Terms are summed from the largest (i = min) downwards in log space; terms more than nine
    standard deviations away are below double precision and are left out.
    """
    n, k = (win + loss).cast("bigint"), F.least(win, loss).cast("bigint")

    def tail(b: Column) -> Column:
        n, k = b["n"], b["k"]
        lowest = F.greatest(
            F.lit(0).cast("bigint"), k - F.ceil(F.sqrt(n.cast("double")) * 9 + 60).cast("bigint")
        )
        top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * F.log(F.lit(2.0))
        # C(n, i-1) / C(n, i) = i / (n - i + 1)
        folded = F.aggregate(
            F.sequence(k, lowest),
            F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
            lambda acc, i: F.struct(
                (acc["term"] * i / (n - i + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")
            ),
            lambda acc: acc["sum"],
        )
        return F.least(F.lit(1.0), 2.0 * F.exp(top) * folded)

    return F.when(n == 0, F.lit(1.0)).otherwise(let(F.struct(n.alias("n"), k.alias("k")), tail))


def paired_comparison(target: DataFrame, baseline: DataFrame, key: str, correct: str, k: str) -> DataFrame:
    """2x2 outcome counts, accuracy difference and sign test over the common ids of two runs."""
    t = target.select(key, F.col(correct).cast("boolean").alias("t"), F.col(k).alias("tk"))
    b = baseline.select(key, F.col(correct).cast("boolean").alias("b"), F.col(k).alias("bk"))
    counts = t.join(b, key).agg(
        F.count("*").alias("common"),
        F.count_if(F.col("t") & F.col("b")).alias("both"),
        F.count_if(F.col("t") & ~F.col("b")).alias("target_only"),
        F.count_if(~F.col("t") & F.col("b")).alias("baseline_only"),
        F.avg("tk").alias("target_mean_k"),
        F.avg("bk").alias("baseline_mean_k"),
    )
    win, loss = F.col("target_only"), F.col("baseline_only")
    return counts.withColumns(
        {
            "neither": F.col("common") - F.col("both") - win - loss,
            "net_wins": win - loss,
            "delta_accuracy": F.coalesce(100.0 * (win - loss) / F.nullif(F.col("common"), F.lit(0)), F.lit(0.0)),
            "sign_test_p": sign_test(win, loss),
        }
    )


def compare_runs(runs: DataFrame, run: str, key: str, correct: str, baseline: str) -> DataFrame:
    """Every run against the baseline run on the ids both have."""
    base = runs.filter(F.col(run) == baseline).select(key, F.col(correct).cast("int").alias("__base"))
    joined = runs.join(base, key)
    hit = F.col(correct).cast("int")
    return joined.groupBy(run).agg(
        F.count("*").alias("common"),
        (100.0 * F.avg(hit)).alias("accuracy"),
        (100.0 * F.avg("__base")).alias("baseline_accuracy"),
        (100.0 * F.avg(hit - F.col("__base"))).alias("delta"),
        F.count_if(hit > F.col("__base")).alias("gained"),
        F.count_if(hit < F.col("__base")).alias("lost"),
    )
