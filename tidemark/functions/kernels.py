"""Recursive indicators, stop automata, and back-tests on arrays of one series, for grouped-map use.

Undefined values are NaN here and null in tables. Indicator values that signals compare are rounded to DP
digits, so that engines which sum in another order decide alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

DP = 6


def sma(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n).mean(axis=1)
    return out


def deviation(x: np.ndarray, n: int) -> np.ndarray:
    """The population standard deviation of the last n values."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n).std(axis=1)
    return out


def extremes_before(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest and lowest of the n values before each."""
    high, low = np.full(len(x), np.nan), np.full(len(x), np.nan)
    if len(x) > n:
        view = np.lib.stride_tricks.sliding_window_view(x[:-1], n)
        high[n:], low[n:] = view.max(axis=1), view.min(axis=1)
    return high, low


def smoothed(x: np.ndarray, alpha: float, least: int) -> np.ndarray:
    """y = (1 - alpha) * y + alpha * x from the first defined value on; undefined until least values came."""
    out = np.full(len(x), np.nan)
    y, seen, keep = math.nan, 0, 1 - alpha
    for i, v in enumerate(x.tolist()):
        if v == v:
            seen += 1
            y = v if seen == 1 else keep * y + alpha * v
        if seen >= least:
            out[i] = y
    return out


def ema(x: np.ndarray, span: int) -> np.ndarray:
    return smoothed(x, 2.0 / (span + 1), span)


def macd(x: np.ndarray, fast: int, slow: int, sign: int) -> tuple[np.ndarray, np.ndarray]:
    line = ema(x, fast) - ema(x, slow)
    return line, ema(line, sign)


def rsi(x: np.ndarray, n: int) -> np.ndarray:
    move = np.diff(x, prepend=x[:1])
    up, down = smoothed(np.maximum(move, 0.0), 1.0 / n, n), smoothed(np.maximum(-move, 0.0), 1.0 / n, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(down == 0, np.where(np.isnan(down), np.nan, 100.0), 100.0 - 100.0 / (1.0 + up / down))


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate((close[:0], close[:-1]))
    out = high - low
    out[1:] = np.maximum(out[1:], np.maximum(np.abs(high[1:] - before), np.abs(low[1:] - before)))
    return out


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    """Wilder's average: 0 before n bars, then their mean, then (last * (n - 1) + range) / n."""
    tr = true_range(high, low, close)
    out = np.zeros(len(tr))
    if len(tr) >= n:
        y = out[n - 1] = float(tr[:n].mean())
        for i, v in enumerate(tr[n:].tolist(), n):
            y = (y * (n - 1) + v) / n
            out[i] = y
    return out


def obv(close: np.ndarray, volume: np.ndarray) -> np.ndarray:
    up = np.concatenate(([True], close[1:] >= close[:-1])) if len(close) else np.zeros(0, bool)
    return np.cumsum(np.where(up, volume, -volume))


def lagged(x: np.ndarray) -> np.ndarray:
    """The value before, with gaps filled forward and a leading gap filled from the first value."""
    out = np.concatenate((np.full(min(1, len(x)), np.nan), x[:-1]))
    return filled(out)


def filled(x: np.ndarray) -> np.ndarray:
    good = np.flatnonzero(~np.isnan(x))
    if not len(good):
        return x
    at = np.searchsorted(good, np.arange(len(x)), side="right") - 1
    return x[good[np.maximum(at, 0)]]


def hold(signal: np.ndarray) -> np.ndarray:
    at = np.maximum.accumulate(np.where(signal != 0, np.arange(len(signal)), -1))
    return np.where(at >= 0, signal[np.maximum(at, 0)], 0)


def stop_automaton(close: np.ndarray, long_: np.ndarray, short: np.ndarray, width: np.ndarray, start: int, side: int = 1, valid: np.ndarray | None = None) -> np.ndarray:
    """Positions that enter when flat and leave when the close crosses the stop that the entry set.

    The stop is width below a long entry and above a short one (side 1), or the other way round (side -1). One
    change per bar: after an exit, the next entry waits for the next bar. Bars that are not valid keep the state.
    """
    out = np.zeros(len(close), dtype=np.int64)
    state, stop = 0, 0.0
    ok = valid.tolist() if valid is not None else [True] * len(close)
    c, up, down, w = close.tolist(), long_.tolist(), short.tolist(), width.tolist()
    for i in range(start, len(c)):
        if ok[i]:
            if state == 0:
                if up[i]:
                    state, stop = 1, c[i] - side * w[i]
                elif down[i]:
                    state, stop = -1, c[i] + side * w[i]
            elif state == 1 and c[i] < stop or state == -1 and c[i] > stop:
                state = 0
        out[i] = state
    return out


def exit_automaton(enter_long: np.ndarray, enter_short: np.ndarray, leave_long: np.ndarray, leave_short: np.ndarray, start: int) -> np.ndarray:
    """Positions that enter when flat and leave on their own condition, one change per bar."""
    out = np.zeros(len(enter_long), dtype=np.int64)
    state = 0
    rows = zip(*(x.tolist() for x in (enter_long, enter_short, leave_long, leave_short)), strict=True)
    for i, (up, down, off_long, off_short) in enumerate(rows):
        if i < start:
            continue
        if state == 0:
            state = 1 if up else -1 if down else 0
        elif state == 1 and off_long or state == -1 and off_short:
            state = 0
        out[i] = state
    return out


def returns(close: np.ndarray, signal: np.ndarray, cost: float) -> np.ndarray:
    """What the last bar's signal earns, less cost times the signal's change; 0 on the first bar."""
    out = np.zeros(len(close))
    with np.errstate(divide="ignore", invalid="ignore"):
        move = close[1:] / close[:-1] - 1
    out[1:] = signal[:-1] * np.where(close[:-1] != 0, move, np.nan) - cost * np.abs(np.diff(signal))
    return np.nan_to_num(out, nan=0.0)


def metrics(ret: np.ndarray, signal: np.ndarray, periods: float) -> dict[str, float]:
    """The 13 metrics of a run; all 0 without bars."""
    n = len(ret)
    if not n:
        return dict.fromkeys(("total_return", "annualized_return", "volatility", "sharpe_ratio", "max_drawdown", "calmar_ratio", "win_rate", "avg_win", "avg_loss", "profit_factor", "total_trades", "winning_trades", "losing_trades"), 0.0)
    curve = np.cumprod(1 + ret)
    top = np.maximum.accumulate(curve)
    won, lost = ret[ret > 0], ret[ret < 0]
    annual = (1 + ret.mean()) ** periods - 1
    vol = ret.std(ddof=1) * math.sqrt(periods) if n > 1 else math.nan
    drawdown = float(((curve - top) / top).min())
    gain, loss = float(won.sum()), float(-lost.sum())
    return {
        "total_return": float(curve[-1] - 1), "annualized_return": float(annual), "volatility": vol, "sharpe_ratio": annual / vol if vol > 0 else 0.0,
        "max_drawdown": drawdown, "calmar_ratio": annual / abs(drawdown) if drawdown != 0 else 0.0, "win_rate": len(won) / n,
        "avg_win": float(won.mean()) if len(won) else 0.0, "avg_loss": float(lost.mean()) if len(lost) else 0.0,
        "profit_factor": gain / loss if loss > 0 else math.inf if gain > 0 else 0.0,
        "total_trades": float(1 + (np.diff(signal) != 0).sum()), "winning_trades": float(len(won)), "losing_trades": float(len(lost)),
    }


Cache = dict[tuple, np.ndarray]


def cached(cache: Cache, key: tuple, make: Callable[[], np.ndarray]) -> np.ndarray:
    """An indicator that several runs over the same series share."""
    if key not in cache:
        cache[key] = make()
    return cache[key]
