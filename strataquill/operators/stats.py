"""Paired statistics over long tables: pairs are rows (family, a, b, diff) made by an inner join on the subject."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(long: DataFrame, subject: str, condition: str, value: str, a, b) -> DataFrame:
    """(subject, x, y, diff) for subjects that have both conditions."""
    left = long.where(F.col(condition) == a).select(subject, F.col(value).alias("x"))
    right = long.where(F.col(condition) == b).select(subject, F.col(value).alias("y"))
    return left.join(right, subject).withColumn("diff", F.col("x") - F.col("y"))


def sign_rank_biserial(diff: Column) -> Column:
    """(positive - negative) / nonzero, 0 without any."""
    return F.coalesce(F.sum(F.signum(diff)) / F.nullif(F.count_if(diff != 0), F.lit(0)), F.lit(0.0))


def upper_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): element n div 2 of each group's sorted values, from counts of equal ones and their running sum."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    placed = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    return placed.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(group).agg(F.min(value).alias(value))


def effects(pairs: DataFrame, family: str) -> DataFrame:
    """(family, n, n_ties, n_used, mean_x, mean_y, median_diff, sign_rank_biserial)."""
    d = F.col("diff")
    out = pairs.groupBy(family).agg(F.count("*").alias("n"), F.count_if(d == 0).alias("n_ties"), F.count_if(d != 0).alias("n_used"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), sign_rank_biserial(d).alias("sign_rank_biserial"))
    medians = upper_medians(pairs, family, "diff").withColumnRenamed("diff", "median_diff")
    return out.join(medians, family, "left").select(family, "n", "n_ties", "n_used", "mean_x", "mean_y", "median_diff", "sign_rank_biserial")


# The coefficients of a Chebyshev fit of the complementary error function, right to 1.2e-7 of its value.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def two_sided(z: Column) -> Column:
    """The share of a normal distribution that is at least so far from the middle; 1 for null."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = poly * t + c
    return F.coalesce(t * F.exp(poly - x * x), F.lit(1.0))


def exact_p(w: Column, n: Column) -> Column:
    """Two-sided exact p of a signed rank sum w of n values without ties: how many subsets of the ranks 1 to n sum to at
    most w, counted rank by rank."""
    def add(ways: Column, rank: Column) -> Column:
        return F.transform(ways, lambda x, i: x + F.when(i >= rank, F.element_at(ways, F.greatest(i - rank, F.lit(0)) + 1)).otherwise(0.0))

    start = F.transform(F.sequence(F.lit(0), F.floor(w).cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, add)
    return F.least(F.lit(1.0), 2 * F.aggregate(ways, F.lit(0.0), lambda s, x: s + x) / F.pow(F.lit(2.0), n))


def wilcoxon(pairs: DataFrame, family: str, min_n: int = 6, exact: int = 50) -> DataFrame:
    """(family, n, n_used, w, z, p): signed ranks of nonzero differences with average ranks for ties; p is
    two-sided: exact up to `exact` differences without ties or zeros, else from the normal limit with tie correction.
    Families under min_n pairs give no row; all ties give w 0 and p 1.

    Ranks come from counts of equal magnitudes and their running sum, so a family's window runs over distinct
    magnitudes, not over pairs."""
    used = pairs.where("diff <> 0").withColumn("mag", F.abs("diff"))
    mags = used.groupBy(family, "mag").agg(F.count("*").alias("t"), F.count_if(F.col("diff") > 0).alias("pos"))
    w = Window.partitionBy(family).orderBy("mag").rowsBetween(Window.unboundedPreceding, -1)
    ranked = mags.withColumn("r", F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2)
    sums = ranked.groupBy(family).agg(F.sum("t").alias("m"), F.sum(F.col("r") * F.col("pos")).alias("plus"), F.sum(F.col("r") * (F.col("t") - F.col("pos"))).alias("minus"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tie"))
    sizes = pairs.groupBy(family).agg(F.count("*").alias("n")).where(F.col("n") >= min_n)
    m = F.coalesce("m", F.lit(0)).cast("double")
    stat = F.coalesce(F.least("plus", "minus"), F.lit(0.0))
    var = m * (m + 1) * (2 * m + 1) / 24 - F.coalesce("tie", F.lit(0.0)) / 48
    out = sizes.join(sums, family, "left").select(family, "n", m.cast("long").alias("n_used"), stat.alias("w"), F.try_divide(stat - m * (m + 1) / 4, F.sqrt(F.when(var > 0, var))).alias("z"), F.coalesce("tie", F.lit(0.0)).alias("tie"))
    small = (F.col("n_used") > 0) & (F.col("n_used") <= exact) & (F.col("n_used") == F.col("n")) & (F.col("tie") == 0)
    return out.withColumn("p", F.when(small, exact_p(F.col("w"), F.col("n_used"))).otherwise(two_sided(F.col("z")))).drop("tie")


def holm(results: DataFrame, p: str, family: str | None = None, key: str = "id") -> DataFrame:
    """results with p_holm: (m - i) p in order of p, at most 1, never falling."""
    part = Window.partitionBy(family) if family else Window.partitionBy(F.lit(1))
    w = part.orderBy(p, key)
    step = F.least(F.lit(1.0), (F.count("*").over(part) - F.row_number().over(w) + 1) * F.col(p))
    out = results.withColumn("__s", step)
    return out.withColumn("p_holm", F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def bootstrap_ci(pairs: DataFrame, family: str, n_boot: int = 5000, seed: int = 42, block: int = 4096) -> DataFrame:
    """(family, ci_low, ci_high) of the mean difference: percentile bootstrap, endpoints at sorted places 2.5 % and
    97.5 %. Differences are counted by value, and a resample is a multinomial draw over those counts. It is drawn in two
    steps, first how many fall into each block of values, then within a block; every task draws the first step alike, by
    the draws' seed, so blocks are resampled apart and only their sums meet."""
    counts = pairs.where("diff is not null").groupBy(family, "diff").agg(F.count("*").alias("c"))
    sizes = counts.groupBy(family).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = counts.join(sizes, family).withColumn("b", F.pmod(F.xxhash64("diff"), F.col("blocks")).cast("int"))
    packed = placed.groupBy(family, "b").agg(F.array_sort(F.collect_list(F.struct("diff", "c"))).alias("v"), F.sum("c").alias("own"))
    shares = packed.groupBy(family).agg(F.array_sort(F.collect_list(F.struct("b", "own"))).alias("all"))
    chunks = packed.join(shares, family).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // 500))))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, b, v, every, chunk in zip(batch[family], batch["b"], batch["v"], batch["all"], batch["chunk"]):
                d, c, own = np.array([x["diff"] for x in v]), np.array([x["c"] for x in v]), np.array([x["own"] for x in every])
                size = min(500, n_boot - 500 * int(chunk))
                into = np.random.default_rng([seed, int(chunk)]).multinomial(own.sum(), own / own.sum(), size)[:, [x["b"] for x in every].index(b)]
                sums = np.random.default_rng([seed, int(chunk), int(b)]).multinomial(into, c / c.sum()) @ d
                rows += [(f, 500 * int(chunk) + i, s / own.sum()) for i, s in enumerate(sums)]
            yield pd.DataFrame(rows, columns=[family, "draw", "mean"])

    kind = pairs.schema[family].dataType.simpleString()
    means = chunks.select(family, "b", "v", "all", "chunk").mapInPandas(draw, f"{family} {kind}, draw int, mean double").groupBy(family, "draw").agg(F.sum("mean").alias("mean"))
    ends = means.groupBy(family).agg(F.array_sort(F.collect_list("mean")).alias("m"))  # n_boot values
    return ends.select(family, F.element_at("m", int(n_boot * 0.025) + 1).alias("ci_low"), F.element_at("m", int(n_boot * 0.975)).alias("ci_high"))


def effective_n(pairs: DataFrame, family: str) -> DataFrame:
    """(family, n, tied, used, pct_used, thin)."""
    tied = F.count_if(F.col("diff") == 0)
    out = pairs.groupBy(family).agg(F.count("*").alias("n"), tied.alias("tied"))
    return out.withColumn("used", F.col("n") - F.col("tied")).withColumn("pct_used", 100.0 * F.col("used") / F.col("n")).withColumn("thin", F.col("pct_used") < 50)
