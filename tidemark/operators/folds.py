"""Operators that carry state from bar to bar, one grouped-map call per series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, windows
from ..schema import VALUES
from .strategies import STRATEGIES

Arrays = dict[str, np.ndarray]


def fold(bars: DataFrame, add: Callable[[Arrays], dict[str, np.ndarray]], schema: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """bars with the columns that add computes from the ordered arrays of each series; NaN becomes null."""
    names = [c.split()[0] for c in schema.split(", ")]
    whole = {c.split()[0] for c in schema.split(", ") if c.split()[1] in ("int", "long")}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx", ignore_index=True)
        made = add({c: pdf[c].to_numpy(dtype=np.float64) for c in VALUES if c in pdf})
        for n in names:
            pdf[n] = made[n] if n in whole else pd.array(np.where(np.isnan(made[n]), 0, made[n]), dtype="Float64")
            if n not in whole:
                pdf.loc[np.isnan(made[n]), n] = pd.NA
        return pdf

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    return bars.groupBy(*keys).applyInPandas(run, f"{old}, {schema}")


def indicator_pack(bars: DataFrame, rsi: int = 14, fast: int = 12, slow: int = 26, sign: int = 9, bands: int = 20, atr: int = 14) -> DataFrame:
    """RSI, MACD and its signal, Bollinger bands, OBV, ATR and three means in one pass over each series."""

    def add(a: Arrays) -> dict[str, np.ndarray]:
        c = a["close"]
        line, signal = kernels.macd(c, fast, slow, sign)
        mid, sd = kernels.sma(c, bands), kernels.deviation(c, bands)
        return {"rsi": kernels.rsi(c, rsi), "macd": line, "macd_signal": signal, "bb_upper": mid + 2 * sd, "bb_lower": mid - 2 * sd, "obv": kernels.obv(c, a["volume"]), "atr": kernels.atr(a["high"], a["low"], c, atr), "sma_5": kernels.sma(c, 5), "sma_10": kernels.sma(c, 10), "sma_20": kernels.sma(c, 20)}

    return fold(bars, add, "rsi double, macd double, macd_signal double, bb_upper double, bb_lower double, obv double, atr double, sma_5 double, sma_10 double, sma_20 double")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, sign: int = 9) -> DataFrame:
    def add(a: Arrays) -> dict[str, np.ndarray]:
        line, signal = kernels.macd(a["close"], fast, slow, sign)
        return {"macd": line, "macd_signal": signal}

    return fold(bars, add, "macd double, macd_signal double")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    return fold(bars, lambda a: {"rsi": kernels.rsi(a["close"], n)}, "rsi double")


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return fold(bars, lambda a: {"atr": kernels.atr(a["high"], a["low"], a["close"], n)}, "atr double")


def ema(bars: DataFrame, n: int = 12) -> DataFrame:
    return fold(bars, lambda a: {"ema": kernels.ema(a["close"], n)}, "ema double")


def signals(bars: DataFrame, strategy: str, params: dict[str, float] | None = None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """bars with the signal of a strategy of the registry."""
    s = STRATEGIES[strategy]
    return fold(bars, lambda a: {"signal": s.signals(a, params)}, "signal int", keys)


def custom_signals(bars: DataFrame, f: Callable[..., pd.Series], params: dict | None = None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """bars with the signal of a user's function of a pandas frame of one series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx", ignore_index=True)
        pdf["signal"] = np.asarray(f(pdf, **(params or {})), dtype=np.int64)
        return pdf

    old = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in bars.schema.fields)
    return bars.groupBy(*keys).applyInPandas(run, f"{old}, signal int")


#: What a model of the next bar sees of indicator_pack().
FEATURES = ("open", "high", "low", "close", "volume", "rsi", "macd", "macd_signal", "bb_upper", "bb_lower", "obv", "atr")


def feature_windows(pack: DataFrame, look_back: int, columns: Sequence[str] = FEATURES, needed: Sequence[str] = ("sma_5", "sma_10", "sma_20")) -> DataFrame:
    """symbol, bar_idx and features: look_back arrays of columns from the rows before, scaled to 0..1 within the window.

    Gaps in columns and needed are filled forward, rows that stay incomplete are dropped, and windows count the rows that
    are left. A column that is constant within a window is 0 there.
    """
    w = windows.series()
    every = (*columns, *needed)
    filled = pack.select("symbol", "bar_idx", *(windows.ffill(c, w).alias(c) for c in every)).dropna(subset=list(every))
    f = w.rowsBetween(-look_back, -1)
    held = filled.select("symbol", "bar_idx", *(F.collect_list(c).over(f).alias(c) for c in columns)).filter(F.size(columns[0]) == look_back)

    def scaled(c: str) -> Column:
        lo, hi = F.array_min(c), F.array_max(c)
        return F.transform(c, lambda x: F.when(hi > lo, (x - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(F.lit(0.0))).alias(c)

    held = held.select("symbol", "bar_idx", *map(scaled, columns))
    rows = F.transform(F.sequence(F.lit(1), F.lit(look_back)), lambda i: F.array(*(F.element_at(c, i) for c in columns)))
    return held.select("symbol", "bar_idx", rows.alias("features"))
