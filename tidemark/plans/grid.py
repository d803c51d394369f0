"""Parameter grids: expansion, checks, evaluation, ranking and sensitivity."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import objective
from ..operators.backtest import FEE, SLIPPAGE
from ..operators.strategies import STRATEGIES
from . import runs


def value_range(first: float, last: float, step: float, inclusive: bool = True) -> list[float]:
    """first, first + step, ... up to last, with or without it."""
    if step <= 0:
        raise ValueError("step must be above 0")
    n = int((last - first) / step + 1e-9)
    out = [round(first + i * step, 10) for i in range(n + 1)] if last >= first else []
    return out if inclusive or not out or out[-1] < last - 1e-9 else out[:-1]


def expand(spark: SparkSession, grid: Mapping[str, Sequence[float]]) -> DataFrame:
    """param_id and one column per parameter: all combinations, numbered with the last parameter fastest."""
    df = spark.range(1).select(F.lit(0).alias("param_id"))
    for name, values in grid.items():
        v = F.array(*[F.lit(float(x)) for x in values])
        df = df.select("*", F.posexplode(v).alias("__p", name)).withColumn("param_id", F.col("param_id") * len(values) + F.col("__p")).drop("__p")
    return df


def checked(params: DataFrame, strategy: str, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """params with an error where a rule (message: condition that must hold) fails; the first rule counts."""
    rules = rules or {m: F.expr(e) for m, e in RULES.get(strategy, {}).items()}
    error = F.lit(None).cast("string")
    for message, holds in reversed(list(rules.items())):
        error = F.when(~F.coalesce(holds, F.lit(False)), message).otherwise(error)
    return params.withColumn("error", error)


#: Rules on columns of a grid: message and SQL condition that must hold.
RULES = {
    "ma_crossover": {"short must be 1 or more": "short >= 1", "short must be below long": "short < long"},
    "donchian": {"lookback must be 2 or more": "lookback >= 2"},
    "rsi_atr": {"rsi_long must be above rsi_short": "rsi_long > rsi_short", "atr_multiplier must be between 0.1 and 10": "atr_multiplier BETWEEN 0.1 AND 10"},
    "bb_atr": {"bb_window must be 2 or more": "bb_window >= 2", "bb_std must be between 0.1 and 10": "bb_std BETWEEN 0.1 AND 10"},
}


def mapped(params: DataFrame) -> DataFrame:
    """param_id and a map of the parameters."""
    names = [c for c in params.columns if c not in ("param_id", "error")]
    return params.select("param_id", F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))]).alias("params"))


def of_strategy(spark: SparkSession, strategy: str) -> DataFrame:
    """The grid over a strategy's own ranges; its defaults alone where it has none."""
    s = STRATEGIES[strategy]
    return expand(spark, {n: value_range(*r) for n, r in s.ranges.items()} or {n: [v] for n, v in s.defaults.items()})


def search(bars: DataFrame, params: DataFrame, strategy: str, by: str | Column = "sharpe_ratio", cost: float = FEE + SLIPPAGE, periods: float = 252, drawdown_sense: str = "parity") -> DataFrame:
    """Metrics, objective and rank of each (symbol, param_id); a combination that fails has objective -Infinity and an error.

    Larger objectives rank first, +Infinity above all, ties by param_id.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    made = runs.grid_runs(bars, mapped(params), strategy, cost, periods)
    return ranked(made.join(params.drop("error"), "param_id"), by, ("symbol",), drawdown_sense)


def quick_optimise(bars: DataFrame, strategy: str, values: Mapping[str, Sequence[float]], by: str | Column = "sharpe_ratio") -> DataFrame:
    """The best parameters and their objective for each series, with default costs."""
    done = best(search(bars, expand(bars.sparkSession, values), strategy, by)).filter("error IS NULL")
    return done.select("symbol", *values, "objective")


def ranked(results: DataFrame, by: str | Column, keys: Sequence[str], drawdown_sense: str = "parity") -> DataFrame:
    value = F.when(F.col("error").isNotNull(), F.lit(float("-inf"))).otherwise(objective(by, drawdown_sense))
    results = results.withColumn("objective", value)
    return results.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("objective").desc_nulls_last(), "param_id")))


def best(results: DataFrame) -> DataFrame:
    return results.filter("rank = 1")


def sensitivity(results: DataFrame, param: str, value: str = "objective") -> DataFrame:
    """Mean, deviation, range and count of the objective for each value of one parameter; failed runs don't count."""
    ok = results.filter(F.col("error").isNull())
    return ok.groupBy(param).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def profile(results: DataFrame, param: str, value: str = "objective") -> DataFrame:
    """Largest, mean and least value per parameter value, and whether it holds the best finite value of all."""
    ok = results.filter(F.col("error").isNull() & (F.abs(F.col(value)) < float("inf")))
    rows = ok.groupBy(param).agg(F.max(value).alias("largest"), F.avg(value).alias("mean"), F.min(value).alias("least"))
    return rows.withColumn("is_best", F.col("largest") == F.max("largest").over(W.partitionBy(F.lit(0))))


def heat_map(results: DataFrame, rows: str, columns: str, values: Sequence[float], value: str = "objective") -> DataFrame:
    """The mean of the objective for each pair of two parameters' values."""
    ok = results.filter(F.col("error").isNull())
    table = ok.groupBy(rows).pivot(columns, list(values)).agg(F.avg(value))
    return table.select(F.col(rows), *[F.col(f"`{v}`").alias(f"{columns}_{v:g}") for v in values])


def final_values(results: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """results with final_value, what the capital became."""
    return results.withColumn("final_value", F.lit(capital) * (1 + F.col("total_return")))


def top(results: DataFrame, n: int, names: Sequence[str]) -> DataFrame:
    """The n best runs with their parameters scaled to 0..1 over these runs (unchanged where all are equal)."""
    ok = results.orderBy(F.col("objective").desc_nulls_last(), "symbol", "param_id").limit(n)
    w = W.partitionBy(F.lit(0))  # n rows
    scaled = {f"{c}_scaled": F.when(F.max(c).over(w) > F.min(c).over(w), (F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))).otherwise(F.col(c)) for c in names}
    return ok.withColumns(scaled)


def random_search(params: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n combinations by a hash of the seed: a stand-in for a tuner's draws."""
    return params.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("param_id"))), "param_id").limit(n)


def successive_halving(bars: DataFrame, params: DataFrame, strategy: str, shares: Sequence[float] = (0.25, 0.5, 1.0), keep: float = 1 / 3, by: str | Column = "sharpe_ratio") -> DataFrame:
    """search() of the combinations that last through the rungs: each rung runs on a longer share of each series' bars,
    and the keep best of its combinations (one at least, by their mean objective over the series) go on to the next."""
    n = F.count(F.lit(1)).over(W.partitionBy("symbol"))
    sized = bars.withColumn("__n", n)
    for i, share in enumerate(shares):
        done = search(sized.filter(F.col("bar_idx") < F.col("__n") * share).drop("__n"), params, strategy, by)
        if i + 1 < len(shares):
            mean = done.filter("error IS NULL").groupBy("param_id").agg(F.avg("objective").alias("__o"))
            best_ = mean.orderBy(F.col("__o").desc_nulls_last(), "param_id").limit(max(1, int(mean.count() * keep)))
            params = params.join(best_.select("param_id"), "param_id", "left_semi")
    return done


def speed_up(bars: DataFrame, params: DataFrame, strategy: str, tasks: Sequence[int] = (1, 2, 4, 8)) -> list[tuple[int, float, float]]:
    """(tasks, seconds, speed-up against the first) of one search with its last stage in so many tasks."""
    out = []
    for n in tasks:
        at = time.perf_counter()
        search(bars, params, strategy).coalesce(n).write.format("noop").mode("overwrite").save()
        out.append((n, time.perf_counter() - at))
    return [(n, s, out[0][1] / s) for n, s in out]
