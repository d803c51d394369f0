"""Monte-Carlo permutation tests: scores of a strategy on permuted bars against its score on the real ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.stats import permutation_statistics
from ..operators import backtest, permutation
from . import grid, runs


def scores(bars: DataFrame, signals: Callable[..., DataFrame], permutations: DataFrame, metric: str = "profit_factor", start: int = 0, mode: str = "both", reconstruction: str = "gap_only", cost: float = backtest.FEE + backtest.SLIPPAGE, periods: float = 252) -> DataFrame:
    """original_score and score of each (symbol, perm_id): a DataFrame strategy on the real bars and on permuted ones."""
    original = backtest.run(signals(bars), ("symbol",), cost, periods).select("symbol", F.col(metric).alias("original_score"))
    moved = permutation.permute(bars, permutations, start, mode, reconstruction)
    own = ("symbol", "perm_id")
    tried = backtest.run(signals(moved, keys=own), own, cost, periods).select(*own, F.col(metric).alias("score"))
    return tried.join(original, "symbol")  # a row per series


def signal_scores(signals: DataFrame, permutations: DataFrame, metric: str = "profit_factor", cost: float = backtest.FEE + backtest.SLIPPAGE, periods: float = 252) -> DataFrame:
    """As scores(), with the order of the signals permuted and the prices kept."""
    original = backtest.run(signals, ("symbol",), cost, periods).select("symbol", F.col(metric).alias("original_score"))
    own = ("symbol", "perm_id")
    tried = backtest.run(permutation.shuffle_signals(signals, permutations), own, cost, periods).select(*own, F.col(metric).alias("score"))
    return tried.join(original, "symbol")


def numpy_scores(bars: DataFrame, strategy: str, params: list[dict[str, float]], n: int, metric: str = "profit_factor", start: int = 0, mode: str = "both", reconstruction: str = "gap_only", cost: float = backtest.FEE + backtest.SLIPPAGE, periods: float = 252) -> DataFrame:
    """As scores(), with numpy's generator (seeds 0 to n - 1) in grouped maps; several params re-optimise each permutation."""
    spark = bars.sparkSession
    seeds = spark.range(n).select(F.col("id").alias("perm_id"))
    table = spark.createDataFrame([(i, {k: float(v) for k, v in p.items()}) for i, p in enumerate(params)], "param_id int, params map<string,double>")
    original = runs.grid_runs(bars, table, strategy, cost, periods).groupBy("symbol").agg(F.max(metric).alias("original_score"))
    tried = runs.permutation_runs(bars, seeds, strategy, params, metric, cost, periods, start, mode, reconstruction)
    return tried.join(original, "symbol")


def statistics(scored: DataFrame) -> DataFrame:
    """p-values, percentile and the distribution of the scores of each series."""
    return scored.groupBy("symbol").agg(*permutation_statistics(F.col("score"), F.col("original_score")))


def reoptimised(bars: DataFrame, frames: Sequence[Callable[..., DataFrame]], permutations: DataFrame, metric: str = "profit_factor", **options) -> DataFrame:
    """As scores(), with the best of several parametrised strategies on the real and on each permuted series."""
    every = None
    for f in frames:
        s = scores(bars, f, permutations, metric, **options)
        every = s if every is None else every.unionByName(s)
    return every.groupBy("symbol", "perm_id").agg(F.max("score").alias("score"), F.max("original_score").alias("original_score"))


def walk_forward_scores(bars: DataFrame, params: DataFrame, strategy: str, permutations: DataFrame, train: int, test: int, step: int | None = None, by: str = "profit_factor", **options) -> DataFrame:
    """original_score and score: the mean out-of-sample objective of a walk-forward on real and permuted bars.

    Each permuted series is a series of its own, so all walk-forwards are one job; only bars from the first
    test bar on are permuted.
    """
    from . import walkforward

    moved = permutation.permute(bars, permutations, train, **{k: options.pop(k) for k in ("mode", "reconstruction") if k in options})
    named = moved.withColumn("symbol", F.concat_ws("\x1f", "symbol", "perm_id")).select(*bars.columns)
    both = bars.withColumn("symbol", F.concat_ws("\x1f", "symbol", F.lit(-1))).unionByName(named)
    done = walkforward.analyse(both, params, strategy, train, test, step, by, **options)
    each = done.groupBy("symbol").agg(F.avg(F.when(F.col(f"oos_{by}") < float("inf"), F.col(f"oos_{by}"))).alias("score"))
    each = each.select(F.split("symbol", "\x1f")[0].alias("symbol"), F.split("symbol", "\x1f")[1].cast("long").alias("perm_id"), "score")
    original = each.filter("perm_id < 0").select("symbol", F.col("score").alias("original_score"))
    return each.filter("perm_id >= 0").join(original, "symbol")


__all__ = ["grid", "numpy_scores", "reoptimised", "scores", "signal_scores", "statistics", "walk_forward_scores"]
