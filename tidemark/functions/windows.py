"""Window helpers. Series are ordered by bar_idx within keys; frames count rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("symbol",)


def series(keys: Sequence[str] = KEYS, order: str = "bar_idx") -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(W.unboundedPreceding, 0)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shift(c: Column | str, w: WindowSpec, n: int = 1) -> Column:
    return F.lag(_col(c), n).over(w)


def pct_change(c: Column | str, w: WindowSpec) -> Column:
    """The relative change to the row before; null on the first row and after a zero."""
    before = shift(c, w)
    return F.when(before != 0, _col(c) / before - 1)


def rolling(f: Callable[[Column], Column], c: Column | str, n: int, w: WindowSpec) -> Column:
    """f over the last n rows, null until n of them are not null."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(_col(c)).over(frame) == n, f(_col(c)).over(frame))


def ffill(c: Column | str, w: WindowSpec) -> Column:
    return F.last(_col(c), ignorenulls=True).over(so_far(w))


def bfill(c: Column | str, w: WindowSpec) -> Column:
    return F.first(_col(c), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))


def hold(signal: Column | str, w: WindowSpec) -> Column:
    """A position that stays until the next signal other than 0."""
    s = _col(signal)
    return F.coalesce(F.last(F.when(s != 0, s), ignorenulls=True).over(so_far(w)), F.lit(0))


def growth(ret: Column | str, w: WindowSpec) -> Column:
    """The running product of 1 + ret."""
    return F.product(1 + _col(ret)).over(so_far(w))


def running_max(c: Column | str, w: WindowSpec) -> Column:
    return F.max(_col(c)).over(so_far(w))


def top_drawdown(curve: Column | str, w: WindowSpec) -> Column:
    """How far a curve is below its highest value so far, as a share of it (0 or less)."""
    top = running_max(curve, w)
    return (_col(curve) - top) / top
