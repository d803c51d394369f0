"""Tables behind reports and charts; drawing them is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.windows import series, top_drawdown
from ..operators import backtest


def backtest_curves(signals: DataFrame, cost: float = backtest.FEE + backtest.SLIPPAGE, capital: float = 100_000.0) -> DataFrame:
    """Per bar: equity, buy-and-hold, drawdown, and a marker where a long or short position starts."""
    done = backtest.curve(backtest.simulate(signals, cost=cost, capital=capital), capital=capital)
    started = F.col("signal") != F.coalesce(F.lag("signal").over(series()), F.lit(0))
    marker = F.when(started & (F.col("signal") == 1), "long").when(started & (F.col("signal") == -1), "short")
    return done.select("symbol", "bar_idx", "ts", "close", "signal", "equity", "buy_hold", "drawdown", marker.alias("marker"))


def walkforward_curves(combined: DataFrame) -> DataFrame:
    """The combined curve with its drawdown."""
    return combined.withColumn("drawdown", top_drawdown("equity", series()))


def checked_scores(scored: DataFrame, p_value: str | None = None) -> DataFrame:
    """scored as it is; ValueError where it has no rows, a score that is null, NaN or infinite, or a p-value outside [0, 1]."""
    value = F.col("score")
    wrong = F.count(F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 1))
    p = F.col(p_value) if p_value else F.lit(0.0)
    n, bad, out = scored.agg(F.count(F.lit(1)), wrong, F.count(F.when(p.isNull() | F.isnan(p) | (p < 0) | (p > 1), 1))).first()
    if not n or bad or out:
        raise ValueError(f"{n} scores, of which {bad} are no finite numbers, and {out} p-values outside 0 to 1")
    return scored


def save_all(path: str, signals: DataFrame | None = None, grid: DataFrame | None = None, params: tuple[str, ...] = (), scores: DataFrame | None = None, combined: DataFrame | None = None) -> list[str]:
    """Write the tables behind all reports of a run under path, those whose input is given, and return their names."""
    from . import grid as grids

    made = {}
    if signals is not None:
        made["backtest"] = backtest_curves(signals)
    if grid is not None:
        made |= {f"optimization_{p}": grids.profile(grid, p) for p in params} | {"optimization_final": grids.final_values(grid)}
    if scores is not None:
        made["mcpt"] = score_distribution(checked_scores(scores))
    if combined is not None:
        made["walkforward"] = walkforward_curves(combined)
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return list(made)


def score_distribution(scored: DataFrame, bins: int = 50) -> DataFrame:
    """A histogram of finite permutation scores per series."""
    return stats.histogram(scored.filter(F.abs("score") < float("inf")), "score", bins, ("symbol",))


def capital_metrics(curve: DataFrame, capital: str = "equity", minutes: float = 60, risk_free: float = 0.02) -> DataFrame:
    """Return in percent, Sharpe of excess returns per bar, drawdown as a positive share, and return over drawdown."""
    w = series()
    per_year = 365 * 24 * 60 / minutes
    df = curve.withColumns({"__r": F.col(capital) / F.nullif(F.lag(capital).over(w), F.lit(0.0)) - 1, "__d": -top_drawdown(capital, w)})
    first, last = F.min_by(capital, "bar_idx"), F.max_by(capital, "bar_idx")
    sd = F.stddev_samp("__r")
    free = (1 + risk_free) ** (1 / per_year) - 1
    total = (last - first) / F.nullif(first, F.lit(0.0)) * 100
    sharpe = F.when(sd > 0, (F.avg("__r") - free) / F.nullif(sd, F.lit(0.0)) * per_year**0.5).otherwise(F.lit(0.0))
    worst = F.max("__d")
    return df.groupBy("symbol").agg(total.alias("total_return_pct"), sharpe.alias("sharpe_ratio"), worst.alias("max_drawdown"), F.when(worst > 0, total / F.nullif(worst, F.lit(0.0))).otherwise(F.lit(-999.0)).alias("return_to_drawdown"))


def finite(value: Column) -> Column:
    """A number for JSON: null in place of NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def summary_json(metrics: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys and a JSON object of the other columns."""
    rest = [finite(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes if c not in keys]
    return metrics.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("summary"))


def text(title: str, values: dict) -> str:
    """A record as lines of text; shares stay numbers, infinite ones are named."""
    width = max(map(len, values), default=0)
    shown = {k: "infinite" if v == float("inf") else f"{v:,.4f}" if isinstance(v, float) else "-" if v is None else str(v) for k, v in values.items()}
    return "\n".join([title, "-" * len(title), *(f"{k:<{width}}  {v}" for k, v in shown.items())])
