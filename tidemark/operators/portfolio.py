"""A simulator of one position per series with sizing, stops, trailing stops and time exits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIZING = ("fixed_ratio", "risk_based", "volatility_based", "hybrid")


@dataclass(frozen=True)
class Rules:
    """Parameters of the simulator. short_mark "parity" values an open short at twice its entry less the price on top
    of the proceeds that cash already holds; "net" at what buying it back costs."""

    capital: float = 100_000.0
    fee: float = 0.001
    slippage: float = 0.001
    stop: float = 0.5
    take: float = 2.0
    hot_take: float = 1.5
    risk: float = 0.005
    most: float = 0.15
    volatility_factor: float = 0.02
    sizing: str = "hybrid"
    least_atr: float = 0.05
    least_reward: float = 0.1
    break_even: float = 0.3
    lock: float = 0.3
    trail: float = 0.05
    hold: int = 72
    confidence: float = 0.005
    atr_mean: int = 50
    short_mark: str = "parity"


class Position:
    """What is held: side 1 or -1 (0: nothing), quantity, entry, stop, trailing stop and bars held."""

    def __init__(self) -> None:
        self.side, self.quantity, self.entry, self.stop, self.trail, self.bars = 0, 0.0, 0.0, 0.0, 0.0, 0

    def value(self, price: float, mark: str) -> float:
        if self.side == 0:
            return 0.0
        if self.side == 1:
            return self.quantity * price
        return self.quantity * (2 * self.entry - price if mark == "parity" else -price)

    def protect(self, price: float, atr: float, r: Rules) -> None:
        """Move the stop to the entry, and the trailing stop behind the price, once the profit is large enough."""
        s = self.side
        closer = max if s == 1 else min
        if s * (price - self.entry) > atr * r.break_even:
            self.stop = closer(self.stop, self.entry)
        if s * (price - self.entry) > atr * r.lock:
            self.trail = closer(self.trail, price * (1 - s * r.trail))

    def leaves(self, price: float, atr: float, mean: float, r: Rules) -> str | None:
        s = self.side
        take = r.take * (r.hot_take if atr > mean else 1.0)
        if s * (price - self.stop) <= 0:
            return "stop"
        if s * (self.trail - self.stop) > 0 and s * (price - self.trail) <= 0:
            return "trail"
        if s * (price - self.entry) >= atr * take:
            return "take"
        return "time" if self.bars > r.hold else None


def quantity(cash: float, price: float, atr: float, r: Rules) -> float:
    cap = cash * r.most / price
    by_risk = cash * r.risk / (atr * r.stop) if atr * r.stop > 0 else 0.0
    by_volatility = cash * r.volatility_factor / atr
    wanted = {"fixed_ratio": cap, "risk_based": by_risk, "volatility_based": by_volatility, "hybrid": min(by_risk, by_volatility)}[r.sizing]
    return min(wanted, cap)


def simulate(rows: dict[str, np.ndarray], r: Rules) -> tuple[np.ndarray, np.ndarray]:
    """The value of the account at each bar and the number of entries so far."""
    n = len(rows["close"])
    atr = rows["atr"]
    overall = float(np.nanmean(atr)) if n and not np.isnan(atr).all() else math.nan
    cash, entries, p = r.capital, 0, Position()
    value, count = np.zeros(n), np.zeros(n, dtype=np.int64)
    for i in range(n):
        price, a = float(rows["close"][i]), float(atr[i])
        mean = float(np.nanmean(atr[i - r.atr_mean : i])) if i >= r.atr_mean else overall
        if price and a and not math.isnan(a) and not a < r.least_atr * mean:
            x = {k: float(rows[k][i]) for k in ("sma_5", "sma_10", "sma_20", "rsi", "macd", "macd_signal", "buy", "sell")}
            if p.side:
                p.bars += 1
                p.protect(price, a, r)
            elif cash > 0 and not (a * r.stop > 0 and r.take / r.stop < r.least_reward):
                cash, entries = _enter(p, cash, entries, price, a, x, r)
            if p.side and (why := p.leaves(price, a, mean, r)):
                out = price if why == "time" else price * (1 - p.side * r.slippage)
                cash += p.side * p.quantity * out - p.quantity * out * r.fee
                p.__init__()
        value[i], count[i] = cash + p.value(price, r.short_mark), entries
    return value, count


def _enter(p: Position, cash: float, entries: int, price: float, atr: float, x: dict[str, float], r: Rules) -> tuple[float, int]:
    q = quantity(cash, price, atr, r)
    if q <= 0:
        return cash, entries
    strong = x["rsi"] > 60 or price > x["sma_10"] or price > x["sma_5"] or x["macd"] > x["macd_signal"]
    weak = x["rsi"] < 40 or price < x["sma_10"] or price < x["sma_5"] or x["macd"] < x["macd_signal"]
    if (x["buy"] >= r.confidence or strong) and (strong or price > x["sma_20"] * 0.995):
        side = 1
    elif (x["sell"] >= r.confidence or weak) and (weak or price < x["sma_20"] * 1.005):
        side = -1
    else:
        return cash, entries
    entry = price * (1 + side * r.slippage)
    fee = q * entry * r.fee
    if cash < (q * entry + fee if side == 1 else fee):
        return cash, entries
    p.side, p.quantity, p.entry, p.bars = side, q, entry, 1
    p.stop = p.trail = entry - side * atr * r.stop
    return cash - side * q * entry - fee, entries + 1


def portfolio(bars: DataFrame, rules: Rules | None = None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """keys, bar_idx, capital and trades from bars with the indicator pack and columns buy and sell (probabilities)."""
    r = rules or Rules()
    if r.sizing not in SIZING:
        raise ValueError(f"unknown sizing {r.sizing}")
    needed = ["close", "atr", "sma_5", "sma_10", "sma_20", "rsi", "macd", "macd_signal", "buy", "sell"]
    options = asdict(r)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx", ignore_index=True)
        rows = {c: pdf[c].to_numpy(dtype=np.float64) for c in needed}
        value, count = simulate(rows, Rules(**options))
        return pdf[[*keys, "bar_idx"]].assign(capital=value, trades=count)

    types = dict(bars.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in (*keys, "bar_idx")) + ", capital double, trades long"
    return bars.select(*keys, "bar_idx", *needed).groupBy(*keys).applyInPandas(run, schema)
