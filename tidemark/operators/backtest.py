"""Back-tests of signals on bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.windows import growth, pct_change, series, shift, top_drawdown

FEE, SLIPPAGE = 0.0006, 0.0001


def simulate(signals: DataFrame, keys: Sequence[str] = ("symbol",), cost: float = FEE + SLIPPAGE, capital: float = 100_000.0) -> DataFrame:
    """signals with position, cost, ret and equity.

    A bar earns the signal of the bar before on its own price change and pays cost for each unit that the
    signal moves. The first bar returns 0 and pays nothing.
    """
    w = series(keys)
    before = F.coalesce(shift("signal", w), F.lit(0))
    first = F.col("bar_idx") == 0
    moved = F.when(first, F.lit(0)).otherwise(F.abs(F.col("signal") - before))
    df = signals.withColumns({"position": before, "cost": moved * F.lit(cost)})
    df = df.withColumn("ret", F.when(first, F.lit(0.0)).otherwise(F.coalesce(F.col("position") * pct_change("close", w) - F.col("cost"), F.lit(0.0))))
    return df.withColumn("equity", F.lit(capital) * growth("ret", w))


def run(signals: DataFrame, keys: Sequence[str] = ("symbol",), cost: float = FEE + SLIPPAGE, periods: float = 252) -> DataFrame:
    """One row of metrics per series: signals, returns and metrics over one exchange."""
    return metrics.summarise(simulate(signals, keys, cost), keys, periods)


def curve(simulated: DataFrame, keys: Sequence[str] = ("symbol",), capital: float = 100_000.0) -> DataFrame:
    """simulated with drawdown and buy_hold, the capital held in the series from its first bar on."""
    w = series(keys)
    first = F.first("close").over(w)
    return simulated.withColumns({"drawdown": top_drawdown("equity", w), "buy_hold": F.lit(capital) * F.col("close") / first})
