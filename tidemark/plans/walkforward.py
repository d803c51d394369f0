"""Rolling walk-forward evaluation: windows are a key, so all windows and parameters run in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import METRICS
from ..operators.backtest import FEE, SLIPPAGE
from . import grid, runs


def windows(bars: DataFrame, train: int, test: int, step: int | None = None, offset: int = 0, least_test: int | None = None) -> DataFrame:
    """window_id and half-open ranges of bar_idx: every start from offset on that leaves train + test bars, per series.

    With least_test, the test slice may be cut at the series' end if it has so many bars.
    """
    step = step or test
    if min(train, test, step) <= 0:
        raise ValueError("train, test and step must be above 0")
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("n")).filter(F.col("n") >= offset + train + (least_test or test))
    starts = counts.select("symbol", "n", F.posexplode(F.sequence(F.lit(offset), F.col("n") - (train + (least_test or test)), F.lit(step))).alias("window_id", "train_start"))
    return starts.select("symbol", "window_id", "train_start", (F.col("train_start") + train).alias("train_end"), (F.col("train_start") + train).alias("test_start"), F.least(F.col("train_start") + train + test, F.col("n")).alias("test_end"))


def members(bars: DataFrame, train: int, test: int, step: int | None = None) -> DataFrame:
    """bars once for each window they are in, with part train or test; by arithmetic, without a join."""
    step = step or test
    n = F.count(F.lit(1)).over(W.partitionBy("symbol"))
    span = train + test
    df = bars.withColumn("__n", n).filter(F.col("__n") >= span)
    first = F.greatest(F.lit(0), F.ceil((F.col("bar_idx") - span + 1) / step)).cast("int")
    last = F.least(F.floor((F.col("__n") - span) / step), F.floor(F.col("bar_idx") / step)).cast("int")
    df = df.withColumns({"__a": first, "__b": last}).filter("__a <= __b").withColumn("window_id", F.explode(F.sequence("__a", "__b")))
    return df.withColumn("part", F.when(F.col("bar_idx") < F.col("window_id") * step + train, "train").otherwise("test")).drop("__n", "__a", "__b")


def analyse(bars: DataFrame, params: DataFrame, strategy: str, train: int, test: int, step: int | None = None, by: str | Column = "sharpe_ratio", cost: float = FEE + SLIPPAGE, periods: float = 252) -> DataFrame:
    """One row per (symbol, window_id): the best parameters on the train bars, is_* there and oos_* on the test bars."""
    spans = windows(bars, train, test, step)
    chosen = grid.mapped(params)
    every = spans.crossJoin(chosen)  # a row per window and combination
    trained = runs.window_runs(bars, every.select("symbol", "window_id", "param_id", "params", F.col("train_start").alias("low"), F.col("train_end").alias("high")), strategy, cost, periods)
    best = grid.best(grid.ranked(trained, by, ("symbol", "window_id"))).filter("error IS NULL")
    inside = best.select("symbol", "window_id", "param_id", *[F.col(m).alias(f"is_{m}") for m in METRICS])
    tests = inside.join(spans, ["symbol", "window_id"]).join(chosen, "param_id")
    outside = runs.window_runs(bars, tests.select("symbol", "window_id", "param_id", "params", F.col("test_start").alias("low"), F.col("test_end").alias("high")), strategy, cost, periods)
    outside = outside.select("symbol", "window_id", *[F.col(m).alias(f"oos_{m}") for m in METRICS], F.col("error").alias("oos_error"))
    return inside.join(outside, ["symbol", "window_id"]).join(params.drop("error"), "param_id")


def summary(results: DataFrame) -> DataFrame:
    """The roll-up of all windows of a series."""
    s, i = F.col("oos_sharpe_ratio"), F.col("is_sharpe_ratio")
    positive = F.count(F.when(F.col("oos_total_return") > 0, 1))
    return results.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg(s).alias("mean_sharpe"), F.stddev_samp(s).alias("std_sharpe"), F.avg("oos_total_return").alias("mean_return"), F.avg("oos_max_drawdown").alias("mean_drawdown"),
        F.avg("oos_profit_factor").alias("mean_profit_factor"), F.avg("oos_win_rate").alias("mean_win_rate"), F.sum("oos_total_trades").alias("total_trades"),
        positive.alias("positive_windows"), F.count(F.when(F.col("oos_total_return") <= 0, 1)).alias("negative_windows"), (positive / F.count(F.lit(1))).alias("consistency"),
        F.coalesce(F.avg(s) / F.nullif(F.avg(i), F.lit(0.0)), F.lit(0.0)).alias("oos_is_ratio"),
    )


def compact_summary(results: DataFrame) -> DataFrame:
    """A shorter roll-up: mean Sharpe, the plain sum of returns, the deepest drawdown and all trades."""
    return results.groupBy("symbol").agg(F.avg("oos_sharpe_ratio").alias("mean_sharpe"), F.sum("oos_total_return").alias("sum_return"), F.min("oos_max_drawdown").alias("max_drawdown"), F.sum("oos_total_trades").alias("total_trades"))


def combined_curve(curves: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """One curve over the test windows of each series, each starting where the last one ended, and buy-and-hold beside it.

    curves has symbol, window_id, bar_idx, close and equity (from each window's own start). A window whose
    first or last equity is 0 or not finite is left out.
    """
    w = W.partitionBy("symbol", "window_id").orderBy("bar_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = curves.withColumns({"__first": F.first("equity").over(w), "__last": F.last("equity").over(w)})
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    df = df.filter(fine("__first") & fine("__last") & (F.col("__first") != 0))
    growth = df.groupBy("symbol", "window_id").agg((F.max("__last") / F.max("__first")).alias("g"))
    ahead = growth.withColumn("ahead", F.coalesce(F.product("g").over(W.partitionBy("symbol").orderBy("window_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0)))
    both = df.join(ahead.drop("g"), ["symbol", "window_id"])
    start = F.first("close").over(W.partitionBy("symbol").orderBy("window_id", "bar_idx").rowsBetween(W.unboundedPreceding, 0))
    return both.select("symbol", "window_id", "bar_idx", (F.lit(capital) * F.col("ahead") * F.col("equity") / F.col("__first")).alias("equity"), (F.lit(capital) * F.col("close") / start).alias("buy_hold"))
