"""Ticks to bars, checks of bars, and alignment of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import series
from ..schema import PRICES, VALUES, cleaned, require


def order_key(ticks: DataFrame, order: Sequence[str]) -> Column:
    """One value that orders rows as the columns do: of a fixed width where they allow it, so that aggregates can hash.

    A single column stands for itself; a time and a whole number become a decimal; others a struct, which makes
    the aggregate sort.
    """
    types = dict(ticks.dtypes)
    if len(order) == 1:
        return F.col(order[0])
    if len(order) == 2 and types[order[0]].startswith("timestamp") and types[order[1]] in ("int", "bigint"):
        micros = F.unix_micros(F.col(order[0]).cast("timestamp")).cast("decimal(18,0)")
        return (micros * F.lit(str(2 * 10**19)).cast("decimal(20,0)") + F.col(order[1]).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.struct(*order)


def from_ticks(ticks: DataFrame, symbol: Column, ts: Column, price: Column, order: Sequence[str], unit: str) -> DataFrame:
    """Bars of one unit of time: one aggregate per symbol and unit, combined before the exchange."""
    t = ticks.select(symbol.alias("symbol"), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("ts"), price.alias("p"), order_key(ticks, order).alias("o"))
    return t.groupBy("symbol", "ts").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


def indexed(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """bars with bar_idx, the place of each bar in its series from 0 on."""
    return bars.withColumn("bar_idx", F.row_number().over(series(keys, "ts")) - 1)


def deduplicated(parts: Sequence[DataFrame], keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """The union of parts with one row per key, that of the first part that has it."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(i))
        every = p if every is None else every.unionByName(p)
    rest = [c for c in every.columns if c not in (*keys, "__part")]
    first = every.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("__part", *rest)).alias("r"))
    return first.select(*keys, *[F.col(f"r.{c}") for c in rest])


def row_flags(bars: DataFrame) -> DataFrame:
    """bars with valid_high, valid_low and valid_ohlc; a comparison with null is not valid."""
    o, h, lo, c = map(F.col, PRICES)
    no = F.lit(False)
    high, low = F.coalesce((h >= o) & (h >= c) & (h >= lo), no), F.coalesce((lo <= o) & (lo <= c) & (lo <= h), no)
    return bars.withColumns({"valid_high": high, "valid_low": low, "valid_ohlc": high & low})


def quality_report(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Counts of missing values, invalid bars, prices not above 0 and negative volumes, and summary numbers; nothing is dropped."""
    require(bars)
    df = row_flags(cleaned(bars))
    count = lambda c: F.count(F.when(c, 1))
    bad = F.lit(False)
    for c in PRICES:
        bad = bad | F.coalesce(F.col(c) <= 0, F.lit(False))
    known = F.lit(True)
    for c in PRICES:
        known = known & F.col(c).isNotNull()
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[count(F.col(c).isNull()).alias(f"missing_{c}") for c in VALUES], count(known & ~F.col("valid_ohlc")).alias("invalid_ohlc"),
        count(bad).alias("non_positive"), count(F.col("volume") < 0).alias("negative_volume"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max("high").alias("highest"), F.min("low").alias("lowest"), F.avg("volume").alias("mean_volume"), F.max("volume").alias("max_volume"),
    )


def is_valid(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per series: whether all prices are positive and no open or close lies outside low and high."""
    o, h, lo, c = map(F.col, PRICES)
    good = F.coalesce((o > 0) & (h > 0) & (lo > 0) & (c > 0) & (h >= o) & (h >= c) & (lo <= o) & (lo <= c), F.lit(False))
    return bars.groupBy(*by).agg(F.bool_and(good).alias("is_valid"))


def align_signals(bars: DataFrame, signals: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """bars with the signal of the same key, 0 where there is none."""
    return bars.join(signals.select(*keys, "signal"), list(keys), "left").withColumn("signal", F.coalesce("signal", F.lit(0)))


def asof(left: DataFrame, right: DataFrame, value: str, by: Sequence[str] = ("symbol",), fill_back: bool = False) -> DataFrame:
    """left with the latest value of right at or before each ts: a union and one window, no join."""
    first = left.select(*by, "ts", F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"), F.lit(1).alias("__left"), F.struct(*left.columns).alias("__row"))
    second = right.select(*by, "ts", F.col(value).alias("__v"), F.lit(0).alias("__left"), F.lit(None).cast(first.schema["__row"].dataType).alias("__row"))
    w = W.partitionBy(*by).orderBy("ts", "__left")
    seen = F.last("__v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    if fill_back:
        seen = F.coalesce(seen, F.first("__v", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    return first.unionByName(second).withColumn(f"asof_{value}", seen).filter("__left = 1").select("__row.*", f"asof_{value}")


def split_at(bars: DataFrame, share: float = 0.7) -> DataFrame:
    """bars with part: train for the first floor(share * n) of each series, then test."""
    n = F.count(F.lit(1)).over(W.partitionBy("symbol"))
    return bars.withColumn("part", F.when(F.col("bar_idx") < F.floor(n * F.lit(share)), "train").otherwise("test"))


def date_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Bars from start to end, both included; a date means its midnight."""
    return bars.filter(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def clean_rows(raw: DataFrame) -> DataFrame:
    """Text rows with readable times and numbers only, typed; others are dropped."""
    typed = raw.select("symbol", F.expr("try_to_timestamp(ts)").cast("timestamp_ntz").alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in VALUES])
    return typed.dropna(subset=["ts", *VALUES])
