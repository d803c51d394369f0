"""Indicators that plain row frames can express; those that feed on their own last value are in kernels."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from .windows import rolling, shift, so_far


def sma(c: Column | str, n: int, w: WindowSpec) -> Column:
    return rolling(F.avg, c, n, w)


def channel(c: str, n: int, w: WindowSpec) -> tuple[Column, Column]:
    """The highest and lowest of the n values before each row."""
    frame = w.rowsBetween(-n, -1)
    full = F.count(F.col(c)).over(frame) == n
    return F.when(full, F.max(c).over(frame)), F.when(full, F.min(c).over(frame))


def bollinger(c: str, n: int, k: float, w: WindowSpec) -> tuple[Column, Column, Column]:
    """Middle, upper and lower band: the mean and k population standard deviations around it."""
    mid, sd = sma(c, n, w), rolling(F.stddev_pop, c, n, w)
    return mid, mid + k * sd, mid - k * sd


def true_range(w: WindowSpec) -> Column:
    """The widest of high - low and the distances of high and low to the close before."""
    before = shift("close", w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def obv(w: WindowSpec) -> Column:
    """Volume summed up with the sign of the close's move; the first bar and unchanged closes count as up."""
    up = F.coalesce(F.col("close") >= shift("close", w), F.lit(True))
    return F.when(up, F.col("volume")).otherwise(-F.col("volume"))


def crossings(fast: str, slow: str, w: WindowSpec) -> Column:
    """1 where fast rises above slow, -1 where it falls below, else 0."""
    f0, s0 = shift(fast, w), shift(slow, w)
    up = (f0 <= s0) & (F.col(fast) > F.col(slow))
    down = (f0 >= s0) & (F.col(fast) < F.col(slow))
    return F.when(F.coalesce(up, F.lit(False)), 1).when(F.coalesce(down, F.lit(False)), -1).otherwise(0)


def running_sum(c: Column | str, w: WindowSpec) -> Column:
    return F.sum(c).over(so_far(w))
