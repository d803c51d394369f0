"""Permutations of bars, ordered by md5 so that any engine draws the same ones, or by numpy in grouped maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import series, shift
from ..schema import VALUES

MODES = ("both", "gap", "intraday")
RECONSTRUCTIONS = ("gap_only", "compounded")


def decompose(bars: DataFrame) -> DataFrame:
    """bars with r_o (the gap to the close before) and r_h, r_l, r_c (against the open), all in logs."""
    w = series()
    before = F.coalesce(shift("close", w), F.col("open"))
    return bars.withColumns({"r_o": F.ln("open") - F.ln(before), "r_h": F.ln("high") - F.ln("open"), "r_l": F.ln("low") - F.ln("open"), "r_c": F.ln("close") - F.ln("open")})


def _order(tag: str):
    return F.md5(F.concat_ws(":", F.col("perm_id"), F.lit(tag), F.col("bar_idx")))


def permute(bars: DataFrame, permutations: DataFrame, start: int = 0, mode: str = "both", reconstruction: str = "gap_only") -> DataFrame:
    """For each perm_id: the bars with everything from start on permuted and prices rebuilt; volume stays.

    Gaps are shuffled on their own and the moves within bars together. gap_only opens each bar at the sum of
    the gaps; compounded adds the moves of the bars before. The bars before start, and all bars where start
    leaves less than two, stay as they are.
    """
    if mode not in MODES or reconstruction not in RECONSTRUCTIONS:
        raise ValueError(f"mode must be one of {MODES}, reconstruction one of {RECONSTRUCTIONS}")
    n = F.count(F.lit(1)).over(W.partitionBy("symbol"))
    cut = decompose(bars).withColumn("anchor", shift("close", series())).withColumn("n", n)
    every = cut.crossJoin(F.broadcast(permutations))
    moves = F.col("bar_idx") >= start
    active = F.col("n") - 1 > start
    still = every.filter(~(moves & active)).select("symbol", "perm_id", "bar_idx", "ts", *VALUES)
    part = every.filter(moves & active)
    own = ("symbol", "perm_id")
    # one grouped pass: the bars in their order, the gaps and the moves in theirs, and all three side by side again
    ordered = lambda tag, moved, *values: F.array_sort(F.collect_list(F.struct((_order(tag) if moved else F.lit("")).alias("by"), "bar_idx", *values)))
    base = F.when(F.col("bar_idx") == start, F.ln(F.coalesce(F.col("anchor"), F.col("open")))).alias("base")
    sides = part.groupBy(*own).agg(ordered("bar", False, "ts", "volume", base).alias("a"), ordered("gap", mode != "intraday", "r_o").alias("b"), ordered("intraday", mode != "gap", "r_h", "r_l", "r_c").alias("c"))
    rows = sides.select(*own, F.explode(F.arrays_zip("a", "b", "c")).alias("x"))
    both = rows.select(*own, *[F.col(f"x.a.{c}").alias(c) for c in ("bar_idx", "ts", "volume", "base")], F.col("x.b.r_o").alias("g"), *[F.col(f"x.c.r_{c}").alias(c) for c in "hlc"])
    w = series(own)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    opened = F.first("base", ignorenulls=True).over(run) + F.sum("g").over(run)
    if reconstruction == "compounded":
        opened = opened + F.coalesce(F.sum("c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    both = both.withColumn("lo", opened)
    o, h, low, c = F.exp("lo"), F.exp(F.col("lo") + F.col("h")), F.exp(F.col("lo") + F.col("l")), F.exp(F.col("lo") + F.col("c"))
    made = both.select(*own, "bar_idx", "ts", o.alias("open"), F.greatest(h, o, c).alias("high"), F.least(low, o, c).alias("low"), c.alias("close"), "volume")
    return made.unionByName(still)


def permute_whole(bars: DataFrame, permutations: DataFrame, start: int = 0) -> DataFrame:
    """For each perm_id: whole bars, with their volume, in another order from start on."""
    every = bars.crossJoin(F.broadcast(permutations)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("symbol", "perm_id")))
    moves = (F.col("bar_idx") >= start) & (F.col("n") - 1 > start)
    own = ("symbol", "perm_id")
    part = every.filter(moves)
    values = part.withColumn("bar_idx", F.row_number().over(W.partitionBy(*own).orderBy(_order("bar"), "bar_idx")) - 1 + start).drop("ts", "n")
    placed = part.select(*own, "bar_idx", "ts").join(values, [*own, "bar_idx"])
    return placed.select(*own, "bar_idx", "ts", *VALUES).unionByName(every.filter(~moves).select(*own, "bar_idx", "ts", *VALUES))


def shuffle_signals(signals: DataFrame, permutations: DataFrame) -> DataFrame:
    """For each perm_id: the bars with their signals in another order."""
    every = signals.select("symbol", "bar_idx", "ts", "close", "signal").crossJoin(F.broadcast(permutations))
    own = ("symbol", "perm_id")
    moved = every.select(*own, "signal", (F.row_number().over(W.partitionBy(*own).orderBy(_order("signal"), "bar_idx")) - 1).alias("bar_idx"))
    return every.drop("signal").join(moved, [*own, "bar_idx"])


def permuted_arrays(a: dict[str, np.ndarray], seed: int, start: int = 0, mode: str = "both", reconstruction: str = "gap_only") -> dict[str, np.ndarray]:
    """permute() of the arrays of one series by numpy's generator, for grouped maps."""
    n = len(a["close"])
    if start >= n - 1:
        return a
    rng = np.random.default_rng(seed)
    logs = {k: np.log(a[k][start:]) for k in ("open", "high", "low", "close")}
    first = np.log(a["close"][start - 1] if start else a["open"][0])
    gap = logs["open"] - np.concatenate(([first], logs["close"][:-1]))
    if mode != "intraday":
        gap = rng.permutation(gap)
    pick = rng.permutation(n - start) if mode != "gap" else np.arange(n - start)
    move = {k: (logs[k] - logs["open"])[pick] for k in ("high", "low", "close")}
    opened = first + np.cumsum(gap)
    if reconstruction == "compounded":
        opened = opened + np.concatenate(([0.0], np.cumsum(move["close"])[:-1]))
    o, h, low, c = np.exp(opened), np.exp(opened + move["high"]), np.exp(opened + move["low"]), np.exp(opened + move["close"])
    new = {"open": o, "high": np.maximum(h, np.maximum(o, c)), "low": np.minimum(low, np.minimum(o, c)), "close": c}
    return {**a, **{k: np.concatenate((a[k][:start], v)) for k, v in new.items()}}
