"""Histograms, a density estimate and the statistics of permutation tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def permutation_statistics(score: Column, original: Column) -> list[Column]:
    """Aggregates over permutation scores against the original score of the same group (failures are -Infinity)."""
    ok = score > float("-inf")
    at_least, below = F.avg((score >= original).cast("double")), F.avg((score < original).cast("double"))
    return [
        F.max(original).alias("original_score"), F.count(score).alias("n_permutations"), at_least.alias("p_value"),
        ((F.count(F.when(ok & (score >= original), 1)) + 1) / (F.count(F.when(ok, 1)) + 1)).alias("p_value_corrected"),
        (below * 100).alias("percentile"), (at_least < 0.05).alias("significant"),
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.median(score).alias("median_score"),
    ]


def histogram(df: DataFrame, value: str, bins: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """bin, low, high, n, density over equal bins from the least to the largest value; one bin if all are equal.

    bins may be an aggregate expression over the group's rows.
    """
    count = bins if isinstance(bins, Column) else F.lit(bins)
    ends = df.groupBy(*by).agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count(value).alias("total"), F.max(count).alias("k") if not isinstance(bins, Column) else count.alias("k"))
    ends = ends.withColumn("k", F.when(F.col("a") == F.col("b"), 1).otherwise(F.col("k")))
    both = df.join(ends, list(by)) if by else df.crossJoin(ends)  # a row per group
    width = (F.col("b") - F.col("a")) / F.col("k")
    place = F.when(F.col("a") == F.col("b"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("a")) / F.nullif(width, F.lit(0.0))), F.col("k") - 1)).cast("int")
    counted = both.filter(F.col(value).isNotNull()).withColumn("bin", place).groupBy(*by, "bin", "a", "b", "k", "total").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*by, "bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), "n", (F.col("n") / F.nullif(F.col("total") * width, F.lit(0.0))).alias("density"))


def dynamic_bins(value: str) -> Column:
    """An aggregate: a number of bins from the logarithm of the rows and the distinct values, between 10 and 50."""
    return F.greatest(F.least(F.floor(F.log2(F.count(value)) + 1), F.count_distinct(F.col(value)), F.lit(50)), F.lit(10))


def density(df: DataFrame, value: str, by: tuple[str, ...], points: int = 200) -> DataFrame:
    """point, x, density: a Gaussian kernel estimate on an even grid over each group's range (Scott's bandwidth)."""
    spread = df.groupBy(*by).agg(F.min(value).alias("a"), F.max(value).alias("b"), (F.stddev_samp(value) * F.pow(F.count(value).cast("double"), F.lit(-0.2))).alias("h"))
    grid = spread.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("a") + F.col("point") * (F.col("b") - F.col("a")) / (points - 1))
    z = (F.col("x") - F.col("__v")) / F.nullif(F.col("h"), F.lit(0.0))
    return df.select(*by, F.col(value).alias("__v")).join(grid, list(by)).groupBy(*by, "point", "x").agg((F.avg(F.exp(-z * z / 2)) / F.max("h") / math.sqrt(2 * math.pi)).alias("density"))
