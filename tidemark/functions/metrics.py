"""The metrics of a run, as aggregates over rows with bar_idx, ret, signal, and the two helper columns of curves()."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import growth, running_max, series, shift

METRICS = ("total_return", "annualized_return", "volatility", "sharpe_ratio", "max_drawdown", "calmar_ratio", "win_rate", "avg_win", "avg_loss", "profit_factor", "total_trades", "winning_trades", "losing_trades")
#: Objectives by name; drawdown_sense "parity" ranks the deepest drawdown first, "best" the shallowest.
OBJECTIVES = ("sharpe_ratio", "profit_factor", "calmar_ratio", "total_return", "max_drawdown")


def profit_factor(ret: Column) -> Column:
    """Gains over losses: infinite with gains only, 0 with neither."""
    won = F.coalesce(F.sum(F.when(ret > 0, ret)), F.lit(0.0))
    lost = -F.coalesce(F.sum(F.when(ret < 0, ret)), F.lit(0.0))
    return F.when(lost > 0, won / F.nullif(lost, F.lit(0.0))).when(won > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def annualized_return(ret: Column, periods: float) -> Column:
    return F.pow(1 + F.avg(ret), F.lit(float(periods))) - 1


def volatility(ret: Column, periods: float) -> Column:
    return F.stddev_samp(ret) * F.sqrt(F.lit(float(periods)))


def sharpe(ret: Column, periods: float) -> Column:
    """Annualised return over annualised volatility, without a risk-free rate; 0 where there is no volatility."""
    vol = volatility(ret, periods)
    return F.when(vol > 0, annualized_return(ret, periods) / F.nullif(vol, F.lit(0.0))).otherwise(F.lit(0.0))


def curves(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """runs with __drawdown of the compounded curve and __trade where the signal changes (the first bar always counts)."""
    w = series(keys)
    df = runs.withColumn("__curve", growth("ret", w)).withColumn("__before", shift("signal", w))
    df = df.withColumn("__drawdown", (F.col("__curve") - running_max("__curve", w)) / running_max("__curve", w))
    return df.withColumn("__trade", F.col("__before").isNull() | (F.col("signal") != F.col("__before")))


def aggregates(periods: float = 252) -> list[Column]:
    """The 13 metrics over the rows that curves() gives."""
    r = F.col("ret")
    drawdown = F.min("__drawdown")
    annual = annualized_return(r, periods)
    count = lambda c: F.count(F.when(c, 1))
    return [
        (F.product(1 + r) - 1).alias("total_return"), annual.alias("annualized_return"), volatility(r, periods).alias("volatility"), sharpe(r, periods).alias("sharpe_ratio"),
        drawdown.alias("max_drawdown"), F.when(drawdown != 0, annual / F.abs(F.nullif(drawdown, F.lit(0.0)))).otherwise(F.lit(0.0)).alias("calmar_ratio"),
        (count(r > 0) / F.nullif(F.count(r), F.lit(0))).alias("win_rate"), F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"),
        profit_factor(r).alias("profit_factor"), count(F.col("__trade")).alias("total_trades"), count(r > 0).alias("winning_trades"), count(r < 0).alias("losing_trades"),
    ]


def summarise(runs: DataFrame, keys: Sequence[str], periods: float = 252) -> DataFrame:
    """One row of metrics per run; all windows and the aggregate share one exchange on the keys."""
    return curves(runs, keys).groupBy(*keys).agg(*aggregates(periods))


def objective(name: str | Column, drawdown_sense: str = "parity") -> Column:
    """What a grid is ranked by, larger first: a name, or any expression over the metrics; ValueError for an unknown name."""
    if isinstance(name, Column):
        return name
    if name not in OBJECTIVES:
        raise ValueError(f"unknown objective {name}; known: {', '.join(OBJECTIVES)}")
    if name == "max_drawdown":
        return -F.col(name) if drawdown_sense == "parity" else F.col(name)
    return F.col(name)
