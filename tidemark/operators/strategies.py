"""Strategies: parameters, their checks, and signals in {-1, 0, 1}.

Each strategy has a kernel over the arrays of one series. Those that row frames can express also have a
DataFrame form. Kernels raise ValueError where parameters or the number of bars don't allow a signal, or give
zeros for few bars, as the table says.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators, kernels
from ..functions.kernels import DP, Cache, cached
from ..functions.windows import hold, rolling, series

Arrays = dict[str, np.ndarray]
Params = dict[str, float]


@dataclass(frozen=True)
class Strategy:
    """A named strategy with defaults, ranges (first, last, step) for grids, and checks of parameters."""

    name: str
    kernel: Callable[[Arrays, Params, Cache], np.ndarray]
    defaults: Params
    ranges: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    check: Callable[[Params], str | None] = lambda p: None
    frame: Callable[..., DataFrame] | None = None

    def signals(self, arrays: Arrays, params: Params | None = None, cache: Cache | None = None) -> np.ndarray:
        """The signal of each bar; ValueError for parameters that the check refuses."""
        p = {**self.defaults, **(params or {})}
        if error := self.check(p):
            raise ValueError(error)
        return self.kernel(arrays, p, {} if cache is None else cache)

    def info(self) -> dict:
        return {"name": self.name, "defaults": self.defaults, "ranges": self.ranges, "has_frame": self.frame is not None}


def _whole(p: Params, name: str, low: int, high: int = 10**9) -> str | None:
    v = p[name]
    return None if float(v).is_integer() and low <= v <= high else f"{name} must be a whole number from {low} to {high}"


def _between(p: Params, name: str, low: float, high: float) -> str | None:
    return None if low <= p[name] <= high else f"{name} must be between {low} and {high}"


def _sma(a: Arrays, n: int, cache: Cache) -> np.ndarray:
    return cached(cache, ("sma", n), lambda: np.round(kernels.sma(a["close"], n), DP))


def _atr(a: Arrays, n: int, cache: Cache) -> np.ndarray:
    return cached(cache, ("atr", n), lambda: np.round(kernels.atr(a["high"], a["low"], a["close"], n), DP))


def _rsi(a: Arrays, n: int, cache: Cache) -> np.ndarray:
    return cached(cache, ("rsi", n), lambda: np.round(kernels.rsi(a["close"], n), DP))


def _macd(a: Arrays, fast: int, slow: int, sign: int, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    both = cached(cache, ("macd", fast, slow, sign), lambda: np.round(np.array(kernels.macd(a["close"], fast, slow, sign)), DP))
    return both[0], both[1]


def _enough(a: Arrays, n: int) -> None:
    if len(a["close"]) < n:
        raise ValueError(f"{len(a['close'])} bars are too few; {n} are needed")


def _state(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    return np.where(up, 1, np.where(down, -1, 0))


def _stopped(a: Arrays, up: np.ndarray, down: np.ndarray, width: np.ndarray, start: int, lines: Sequence[np.ndarray], side: int = 1) -> np.ndarray:
    valid = ~np.isnan(a["close"])
    for x in lines:
        valid &= ~np.isnan(x)
    return kernels.stop_automaton(a["close"], up, down, width, start, side, valid)


def donchian(a: Arrays, p: Params, cache: Cache) -> np.ndarray:
    n = int(p["lookback"])
    _enough(a, n)
    high, low = kernels.extremes_before(a["close"], n)
    return kernels.hold(_state(a["close"] > high, a["close"] < low))


def donchian_frame(bars: DataFrame, lookback: int = 20, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    w = series(keys)
    high, low = indicators.channel("close", lookback, w)
    df = bars.withColumns({"upper": high, "lower": low})
    df = df.withColumn("raw", F.when(F.col("close") < F.col("lower"), -1).when(F.col("close") > F.col("upper"), 1).otherwise(0))
    return df.withColumn("signal", hold("raw", w)).drop("raw")


def ma_crossover(a: Arrays, p: Params, cache: Cache) -> np.ndarray:
    short, long_ = int(p["short"]), int(p["long"])
    _enough(a, long_)
    f, s = _sma(a, short, cache), _sma(a, long_, cache)
    before = lambda x: np.concatenate(([np.nan], x[:-1]))
    f0, s0 = before(f), before(s)
    return kernels.hold(_state((f0 <= s0) & (f > s), (f0 >= s0) & (f < s)))


def ma_crossover_frame(bars: DataFrame, short: int = 10, long: int = 30, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    w = series(keys)
    df = bars.withColumns({"fast": F.round(indicators.sma("close", short, w), DP), "slow": F.round(indicators.sma("close", long, w), DP)})
    return df.withColumn("cross", indicators.crossings("fast", "slow", w)).withColumn("signal", hold("cross", w))


def sma_state(a: Arrays, p: Params, cache: Cache) -> np.ndarray:
    s = _sma(a, int(p["period"]), cache)
    return _state(a["close"] > s, a["close"] < s)


def sma_state_frame(bars: DataFrame, period: int = 20, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    df = bars.withColumn("sma", F.round(indicators.sma("close", period, series(keys)), DP))
    return df.withColumn("signal", F.when(F.col("close") > F.col("sma"), 1).when(F.col("close") < F.col("sma"), -1).otherwise(0))


def ma_state(a: Arrays, p: Params, cache: Cache) -> np.ndarray:
    f, s = _sma(a, int(p["fast"]), cache), _sma(a, int(p["slow"]), cache)
    return _state(f > s, f < s)


def ma_state_frame(bars: DataFrame, fast: int = 10, slow: int = 20, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    w = series(keys)
    df = bars.withColumns({"fast": F.round(indicators.sma("close", fast, w), DP), "slow": F.round(indicators.sma("close", slow, w), DP)})
    return df.withColumn("signal", F.when(F.col("fast") > F.col("slow"), 1).when(F.col("fast") < F.col("slow"), -1).otherwise(0))


def ma_atr_filter_frame(bars: DataFrame, short: int = 10, long: int = 30, atr: int = 14, mean: int = 50, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    w = series(keys)
    df = bars.withColumns({"fast": F.round(indicators.sma("close", short, w), DP), "slow": F.round(indicators.sma("close", long, w), DP), "tr": indicators.true_range(w)})
    df = df.withColumn("atr", F.round(rolling(F.avg, "tr", atr, w), DP))
    df = df.withColumn("atr_mean", F.round(rolling(F.avg, "atr", mean, w), DP))
    lively = F.coalesce(F.col("atr") > F.col("atr_mean"), F.lit(False))
    return df.withColumn("signal", F.when(lively & (F.col("fast") > F.col("slow")), 1).when(lively & (F.col("fast") < F.col("slow")), -1).otherwise(0))


def ma_atr_filter(a: Arrays, p: Params, cache: Cache) -> np.ndarray:
    f, s = _sma(a, int(p["short"]), cache), _sma(a, int(p["long"]), cache)
    r = np.round(kernels.sma(kernels.true_range(a["high"], a["low"], a["close"]), int(p["atr"])), DP)
    m = np.full(len(r), np.nan)
    n = int(p["atr"]) - 1
    m[n:] = np.round(kernels.sma(r[n:], int(p["mean"])), DP)
    return _state((r > m) & (f > s), (r > m) & (f < s))


def bb_atr(a: Arrays, p: Params, cache: Cache) -> np.ndarray:
    """Breakouts of the last bar's Bollinger bands; the stop lies on the entry's far side."""
    n, m = int(p["bb_window"]), int(p["atr_window"])
    _enough(a, max(n, m) + 10)
    mid = cached(cache, ("mid", n), lambda: kernels.sma(a["close"], n))
    sd = cached(cache, ("sd", n), lambda: kernels.deviation(a["close"], n))
    up, low = kernels.lagged(np.round(mid + p["bb_std"] * sd, DP)), kernels.lagged(np.round(mid - p["bb_std"] * sd, DP))
    r = kernels.lagged(_atr(a, m, cache))
    c = a["close"]
    return _stopped(a, c > up, c < low, p["atr_multiplier"] * r, max(n, m) + 1, (up, low, r), side=-1)


def macd_atr(a: Arrays, p: Params, cache: Cache) -> np.ndarray:
    slow, m = int(p["macd_slow"]), int(p["atr_window"])
    start = max(slow, m) + 5
    if len(a["close"]) < start:
        return np.zeros(len(a["close"]), dtype=np.int64)
    line, sign = map(kernels.lagged, _macd(a, int(p["macd_fast"]), slow, int(p["macd_signal"]), cache))
    r = kernels.lagged(_atr(a, m, cache))
    return _stopped(a, line > sign, line < sign, p["atr_multiplier"] * r, start, (line, sign, r))


def rsi_atr(a: Arrays, p: Params, cache: Cache) -> np.ndarray:
    n, m = int(p["rsi_window"]), int(p["atr_window"])
    if len(a["close"]) < max(n, m) + 10:
        return np.zeros(len(a["close"]), dtype=np.int64)
    x, r = kernels.lagged(_rsi(a, n, cache)), kernels.lagged(_atr(a, m, cache))
    return _stopped(a, x > p["rsi_long"], x < p["rsi_short"], p["atr_multiplier"] * r, max(n, m) + 1, (x, r))


def sma_atr(a: Arrays, p: Params, cache: Cache) -> np.ndarray:
    n, m = int(p["sma_period"]), int(p["atr_window"])
    start = max(n, m) + 5
    if len(a["close"]) < start:
        return np.zeros(len(a["close"]), dtype=np.int64)
    s, r = kernels.lagged(_sma(a, n, cache)), kernels.lagged(_atr(a, m, cache))
    return _stopped(a, a["close"] > s, a["close"] < s, p["atr_multiplier"] * r, start, (s, r))


def multi_indicator(a: Arrays, p: Params, cache: Cache) -> np.ndarray:
    """RSI, a mean and MACD agree to enter; any of them turning leaves."""
    n, k, slow = int(p["rsi_window"]), int(p["sma_period"]), int(p["macd_slow"])
    start = max(k, slow, n) + 5
    if len(a["close"]) < start:
        return np.zeros(len(a["close"]), dtype=np.int64)
    x, s = kernels.filled(_rsi(a, n, cache)), kernels.filled(_sma(a, k, cache))
    line, sign = map(kernels.filled, _macd(a, int(p["macd_fast"]), slow, int(p["macd_signal"]), cache))
    c = a["close"]
    low, high = max(0.0, p["rsi_short"] - p["rsi_exit_offset"]), min(100.0, p["rsi_long"] + p["rsi_exit_offset"])
    return kernels.exit_automaton(
        (x > p["rsi_long"]) & (c > s) & (line > sign), (x < p["rsi_short"]) & (c < s) & (line < sign),
        (x < low) | (c < np.round(s * p["sma_long_buffer"], DP)) | (line < sign), (x > high) | (c > np.round(s * p["sma_short_buffer"], DP)) | (line > sign), start,
    )


def _first(*errors: str | None) -> str | None:
    return next((e for e in errors if e), None)


STRATEGIES = {
    s.name: s
    for s in (
        Strategy("donchian", donchian, {"lookback": 20}, {"lookback": (10, 100, 10)}, lambda p: _whole(p, "lookback", 2), donchian_frame),
        Strategy("ma_crossover", ma_crossover, {"short": 10, "long": 30}, {"short": (5, 50, 5), "long": (20, 200, 10)}, lambda p: _first(_whole(p, "short", 1), _whole(p, "long", 2), None if p["short"] < p["long"] else "short must be below long"), ma_crossover_frame),
        Strategy("bb_atr", bb_atr, {"bb_window": 20, "bb_std": 2.0, "atr_window": 14, "atr_multiplier": 2.0}, {"bb_window": (10, 50, 5), "bb_std": (1.0, 3.0, 0.5), "atr_window": (7, 28, 7), "atr_multiplier": (1.0, 4.0, 0.5)}, lambda p: _first(_whole(p, "bb_window", 2), _whole(p, "atr_window", 1), _between(p, "bb_std", 0.1, 10), _between(p, "atr_multiplier", 0.1, 10))),
        Strategy("macd_atr", macd_atr, {"macd_fast": 12, "macd_slow": 26, "macd_signal": 9, "atr_window": 14, "atr_multiplier": 2.0}),
        Strategy("rsi_atr", rsi_atr, {"rsi_window": 14, "rsi_long": 60, "rsi_short": 40, "atr_window": 14, "atr_multiplier": 2.0}, {"rsi_window": (7, 28, 7), "rsi_long": (55, 75, 5), "rsi_short": (25, 45, 5), "atr_window": (7, 28, 7), "atr_multiplier": (1.0, 4.0, 0.5)}, lambda p: _first(_whole(p, "rsi_window", 2, 100), _whole(p, "atr_window", 1, 100), _between(p, "rsi_long", 0, 100), _between(p, "rsi_short", 0, 100), None if p["rsi_long"] > p["rsi_short"] else "rsi_long must be above rsi_short", _between(p, "atr_multiplier", 0.1, 10))),
        Strategy("sma_atr", sma_atr, {"sma_period": 20, "atr_window": 14, "atr_multiplier": 2.0}),
        Strategy("multi_indicator", multi_indicator, {"rsi_window": 14, "rsi_long": 55, "rsi_short": 45, "rsi_exit_offset": 5, "macd_fast": 12, "macd_slow": 26, "macd_signal": 9, "sma_period": 20, "sma_long_buffer": 0.98, "sma_short_buffer": 1.02}),
        Strategy("sma_state", sma_state, {"period": 20}, {"period": (5, 50, 5)}, lambda p: _whole(p, "period", 1), sma_state_frame),
        Strategy("ma_state", ma_state, {"fast": 10, "slow": 20}, {"fast": (5, 15, 5), "slow": (20, 40, 10)}, lambda p: None, ma_state_frame),
        Strategy("ma_atr_filter", ma_atr_filter, {"short": 10, "long": 30, "atr": 14, "mean": 50}, {}, lambda p: None, ma_atr_filter_frame),
    )
}
