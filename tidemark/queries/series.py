"""Queries: scans, checks, alignment, indicators and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions import windows as X
from ..operators import bars as B
from ..operators import folds, permutation, strategies
from ..schema import VALUES
from ..sources import files, klines
from ..sources.scratch import scratch
from .base import D, H, W, daily, held, hourly, hourly_ticks, query, r, rolled, rounded, table

BAR = "symbol, ts, bar_idx, open, high, low, close, volume"


@query(f"WITH {H} SELECT {BAR} FROM bars")
def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir)


@query(f"WITH {D} SELECT {BAR} FROM bars")
def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir)


@query("SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate) AS ts, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, count(*)::DOUBLE AS volume FROM lineitem GROUP BY 1, 2")
def bars_1d_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return B.from_ticks(t, F.col("l_returnflag"), F.col("l_shipdate"), price, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "day").select("symbol", "ts", "high", "low", "volume")


@query(f"WITH {H} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def scan_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written by the sink and read again through the scan."""
    path = scratch(spark, "bars")
    hourly_ticks(spark, sf_dir).write.parquet(path)
    return files.scan(spark, path)


@query(f"WITH {H} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through CSV with ISO timestamps."""
    path = scratch(spark, "csv")
    files.save_bars(hourly_ticks(spark, sf_dir), path, "csv")
    raw = spark.read.option("header", True).schema("symbol string, ts string, open string, high string, low string, close string, volume string").csv(path)
    return B.clean_rows(raw.withColumn("ts", F.regexp_replace("ts", r"\+0000$", "")))


@query("SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.date_range(table(spark, sf_dir, "events"), "2024-01-05", "2024-01-12").select("event_id", "ts", "value")


@query(f"WITH {H} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def dedup_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping parts, of which the first one counts."""
    b = hourly_ticks(spark, sf_dir)
    return B.deduplicated([b, b.withColumn("close", F.col("close") + 1)]).select("symbol", "ts", *VALUES)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ts, 1000.0::DOUBLE + value AS open, 1000.0::DOUBLE + value + 1 AS high, 1000.0::DOUBLE + value - 1 AS low, 1000.0::DOUBLE + value AS close, 1.0::DOUBLE AS volume FROM events")
def kline_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange pages of all shapes (named or positional, under result or data), built from events and decoded by built-in functions."""
    e = table(spark, sf_dir, "events")
    price = F.lit(1000.0) + F.col("value")
    text = lambda c: c.cast("string")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    named = F.struct(text(ms).alias("t"), text(price).alias("open"), text(price + 1).alias("h"), text(price - 1).alias("low"), text(price).alias("c"), F.lit("1").alias("vol"))
    placed = F.array(text(ms), text(price), text(price + 1), text(price - 1), text(price), F.lit("1"))
    shapes = [
        F.to_json(F.struct(F.lit(0).alias("retCode"), F.struct(F.array(named).alias("list")).alias("result"))), F.to_json(F.struct(F.array(named).alias("data"))),
        F.to_json(F.struct(F.lit(0).alias("retCode"), F.struct(F.array(placed).alias("list")).alias("result"))), F.to_json(F.struct(F.array(placed).alias("data"))),
    ]
    page = F.element_at(F.array(*shapes), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", F.explode(klines.decode(page)).alias("c")).select("event_id", "c.*")


@query("""
WITH grid AS (SELECT unnest(generate_series(TIMESTAMP '2022-01-01', TIMESTAMP '2024-01-01', INTERVAL 1 HOUR)) AS ts),
n AS (SELECT ts, CAST(epoch(ts) / 3600 AS BIGINT) AS i FROM grid),
p AS (SELECT ts, i, 100 + (i * 7919 % 1000) / 10.0::DOUBLE AS price, 100 + ((i + 1) * 7919 % 1000) / 10.0::DOUBLE AS next FROM n)
SELECT 'BTCUSDT' AS symbol, ts, round(price, 6) AS open, round(price + 2, 6) AS high, round(price - 2, 6) AS low,
       round(CASE WHEN abs(next - price) <= 2 THEN next ELSE price END, 6) AS close, (i % 50)::DOUBLE AS volume FROM p
""")
def rest_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exchange source over two years in yearly spans, offline."""
    return rounded(klines.read(spark, symbol="BTCUSDT", interval="1h", start="2022-01-01", end="2024-01-01", fetch="tidemark.sources.klines:offline"))


@query("SELECT event_type AS symbol, ts, 1000 + value AS close FROM events WHERE event_id % 7 <> 0")
def clean_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows, of which some have no number or no time."""
    e = table(spark, sf_dir, "events")
    bad = F.col("event_id") % 7 == 0
    price = (F.lit(1000.0) + F.col("value")).cast("string")
    raw = e.select(F.col("event_type").alias("symbol"), F.when(bad & (F.col("event_id") % 2 == 0), "no time").otherwise(F.col("ts").cast("string")).alias("ts"), *[F.when(bad & (F.col("event_id") % 2 == 1), "n/a").otherwise(price).alias(c) for c in VALUES])
    return B.clean_rows(raw).select("symbol", "ts", "close")


@query(f"""WITH {D}, dirty AS (SELECT symbol, ts, CASE WHEN bar_idx % 11 = 0 THEN NULL ELSE open END AS open, CASE WHEN bar_idx % 13 = 0 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN bar_idx % 17 = 0 THEN -close ELSE close END AS close, CASE WHEN bar_idx % 19 = 0 THEN -1.0::DOUBLE ELSE volume END AS volume FROM bars)
SELECT symbol, count(*) AS n_rows, count(*) - count(open) AS missing_open, count(*) - count(high) AS missing_high, count(*) - count(low) AS missing_low, count(*) - count(close) AS missing_close, count(*) - count(volume) AS missing_volume,
  count(*) FILTER (open IS NOT NULL AND NOT (high >= open AND high >= close AND high >= low AND low <= open AND low <= close)) AS invalid_ohlc,
  count(*) FILTER (coalesce(open <= 0, false) OR high <= 0 OR low <= 0 OR close <= 0) AS non_positive, count(*) FILTER (volume < 0) AS negative_volume,
  min(ts) AS first_ts, max(ts) AS last_ts, max(high) AS highest, min(low) AS lowest, {r('avg(volume)', 'mean_volume')}, max(volume) AS max_volume
FROM dirty GROUP BY symbol""")
def ohlc_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.quality_report(_dirty(daily(spark, sf_dir))))


def _dirty(b: DataFrame) -> DataFrame:
    i = F.col("bar_idx")
    return b.withColumns({"open": F.when(i % 11 != 0, F.col("open")), "high": F.when(i % 13 == 0, F.col("low") - 1).otherwise(F.col("high")), "close": F.when(i % 17 == 0, -F.col("close")).otherwise(F.col("close")), "volume": F.when(i % 19 == 0, F.lit(-1.0)).otherwise(F.col("volume"))})


@query(f"""WITH {D}, dirty AS (SELECT symbol, bar_idx, CASE WHEN bar_idx % 11 = 0 THEN NULL ELSE open END AS open, CASE WHEN bar_idx % 13 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN bar_idx % 17 = 0 THEN -close ELSE close END AS close FROM bars),
f AS (SELECT symbol, bar_idx, coalesce(high >= open AND high >= close AND high >= low, false) AS valid_high, coalesce(low <= open AND low <= close AND low <= high, false) AS valid_low FROM dirty)
SELECT *, valid_high AND valid_low AS valid_ohlc FROM f""")
def ohlc_row_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.row_flags(_dirty(daily(spark, sf_dir))).select("symbol", "bar_idx", "valid_high", "valid_low", "valid_ohlc")


@query(f"WITH {D} SELECT symbol, bool_and(open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= open AND high >= close AND low <= open AND low <= close) AS is_valid FROM bars GROUP BY symbol")
def ohlc_is_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.is_valid(daily(spark, sf_dir))


@query(f"WITH {H} SELECT symbol, bar_idx, close, CASE WHEN bar_idx % 3 = 0 THEN 1 ELSE 0 END AS signal FROM bars")
def align_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hourly(spark, sf_dir)
    s = b.filter("bar_idx % 3 = 0").select("symbol", "ts", F.lit(1).alias("signal"))
    return B.align_signals(b, s).select("symbol", "bar_idx", "close", "signal")


@query(f"WITH {H} SELECT symbol, bar_idx, last_value(CASE WHEN bar_idx % 5 = 2 THEN close END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asof_level FROM bars")
def asof_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hourly(spark, sf_dir)
    levels = b.filter("bar_idx % 5 = 2").select("symbol", "ts", F.col("close").alias("level"))
    return B.asof(b, levels, "level").select("symbol", "bar_idx", "asof_level")


@query(f"WITH {H} SELECT symbol, bar_idx, CASE WHEN bar_idx < floor(count(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM bars")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.split_at(hourly(spark, sf_dir)).select("symbol", "bar_idx", "part")


@query(f"WITH {H} SELECT symbol, bar_idx, close FROM bars WHERE bar_idx >= 100 AND bar_idx < 200")
def positional_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).filter("bar_idx >= 100 AND bar_idx < 200").select("symbol", "bar_idx", "close")


@query(f"WITH {H} SELECT symbol, bar_idx, {r(f'close / lag(close) OVER ({W}) - 1', 'change', 9)} FROM bars")
def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_idx", X.pct_change("close", X.series()).alias("change")), 9)


@query(f"WITH {H} SELECT symbol, bar_idx, {r(f'lag(close, 1) OVER ({W})', 'before')}, {r(f'close - lag(close) OVER ({W})', 'moved')} FROM bars")
def shift_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = X.shift("close", X.series())
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_idx", before.alias("before"), (F.col("close") - before).alias("moved")))


@query(f"WITH {H} SELECT symbol, bar_idx, {', '.join(r(rolled('avg', 'close', n), f'sma_{n}') for n in (5, 10, 20))} FROM bars")
def sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.series()
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_idx", *[I.sma("close", n, w).alias(f"sma_{n}") for n in (5, 10, 20)]))


_CH = f"count(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20"


@query(f"WITH {H} SELECT symbol, bar_idx, CASE WHEN {_CH} THEN max(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS upper, CASE WHEN {_CH} THEN min(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS lower FROM bars")
def donchian_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = I.channel("close", 20, X.series())
    return hourly(spark, sf_dir).select("symbol", "bar_idx", high.alias("upper"), low.alias("lower"))


@query(f"WITH {H}, b AS (SELECT *, {rolled('avg', 'close', 20)} AS m, {rolled('stddev_pop', 'close', 20)} AS s FROM bars) SELECT symbol, bar_idx, {r('m', 'middle')}, {r('m + 2 * s', 'upper')}, {r('m - 2 * s', 'lower')} FROM b")
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid, up, low = I.bollinger("close", 20, 2.0, X.series())
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_idx", mid.alias("middle"), up.alias("upper"), low.alias("lower")))


_TR = f"greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W})))"


@query(f"WITH {H} SELECT symbol, bar_idx, {r(_TR, 'tr')} FROM bars")
def true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_idx", I.true_range(X.series()).alias("tr")))


@query(f"WITH {H}, t AS (SELECT *, {_TR} AS tr FROM bars) SELECT symbol, bar_idx, {r(rolled('avg', 'tr', 14), 'atr')} FROM t")
def atr_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.series()
    return rounded(hourly(spark, sf_dir).withColumn("tr", I.true_range(w)).select("symbol", "bar_idx", X.rolling(F.avg, "tr", 14, w).alias("atr")))


@query(f"WITH {H}, s AS (SELECT *, CASE WHEN coalesce(close >= lag(close) OVER ({W}), true) THEN volume ELSE -volume END AS v FROM bars) SELECT symbol, bar_idx, sum(v) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv FROM s")
def obv(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.series()
    return hourly(spark, sf_dir).withColumn("v", I.obv(w)).select("symbol", "bar_idx", I.running_sum("v", w).alias("obv"))


#: SQL: the recursions of two exponential means, Wilder's averages of gains and losses, and of the true range.
REC = f"""
t AS (SELECT *, {_TR} AS tr FROM bars),
u AS (SELECT *, avg(tr) OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS mean_tr, close - lag(close) OVER ({W}) AS mv FROM t),
rec AS (
  SELECT symbol, bar_idx, close, high, low, volume, close AS fast, close AS slow, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0.0::DOUBLE AS atr FROM u WHERE bar_idx = 0
  UNION ALL
  SELECT u.symbol, u.bar_idx, u.close, u.high, u.low, u.volume, (1 - 2.0::DOUBLE / 13) * p.fast + 2.0::DOUBLE / 13 * u.close, (1 - 2.0::DOUBLE / 27) * p.slow + 2.0::DOUBLE / 27 * u.close,
         (1 - 1.0::DOUBLE / 14) * p.up + 1.0::DOUBLE / 14 * greatest(u.mv, 0), (1 - 1.0::DOUBLE / 14) * p.down + 1.0::DOUBLE / 14 * greatest(-u.mv, 0),
         CASE WHEN u.bar_idx < 13 THEN 0 WHEN u.bar_idx = 13 THEN u.mean_tr ELSE (p.atr * 13 + u.tr) / 14 END
  FROM rec p JOIN u ON u.symbol = p.symbol AND u.bar_idx = p.bar_idx + 1
),
ind AS (SELECT *, CASE WHEN bar_idx >= 25 THEN fast - slow END AS macd,
               CASE WHEN bar_idx >= 13 THEN CASE WHEN down = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + up / down) END END AS rsi FROM rec),
sgn AS (
  SELECT symbol, bar_idx, macd AS e FROM ind WHERE bar_idx = 25
  UNION ALL
  SELECT i.symbol, i.bar_idx, (1 - 2.0::DOUBLE / 10) * p.e + 2.0::DOUBLE / 10 * i.macd FROM sgn p JOIN ind i ON i.symbol = p.symbol AND i.bar_idx = p.bar_idx + 1
),
full_ AS (SELECT i.*, CASE WHEN i.bar_idx >= 33 THEN s.e END AS macd_signal FROM ind i LEFT JOIN sgn s ON s.symbol = i.symbol AND s.bar_idx = i.bar_idx)"""


@query(f"WITH RECURSIVE {H}, {REC} SELECT symbol, bar_idx, {r('CASE WHEN bar_idx >= 11 THEN fast END', 'ema')} FROM full_")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.ema(hourly(spark, sf_dir), 12).select("symbol", "bar_idx", "ema"))


@query(f"WITH RECURSIVE {H}, {REC} SELECT symbol, bar_idx, {r('macd')}, {r('macd_signal')} FROM full_")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.macd(hourly(spark, sf_dir)).select("symbol", "bar_idx", "macd", "macd_signal"))


@query(f"WITH RECURSIVE {H}, {REC} SELECT symbol, bar_idx, {r('rsi')} FROM full_")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.rsi(hourly(spark, sf_dir)).select("symbol", "bar_idx", "rsi"))


@query(f"WITH RECURSIVE {H}, {REC} SELECT symbol, bar_idx, {r('atr')} FROM full_")
def atr_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.atr(hourly(spark, sf_dir)).select("symbol", "bar_idx", "atr"))


_PACK = f"""pk AS (SELECT *, {rolled('avg', 'close', 20)} AS m, {rolled('stddev_pop', 'close', 20)} AS s, {rolled('avg', 'close', 5)} AS sma_5, {rolled('avg', 'close', 10)} AS sma_10,
  CASE WHEN coalesce(close >= lag(close) OVER ({W}), true) THEN volume ELSE -volume END AS v FROM full_)"""


@query(f"WITH RECURSIVE {H}, {REC}, {_PACK} SELECT symbol, bar_idx, {r('rsi')}, {r('macd')}, {r('macd_signal')}, {r('m + 2 * s', 'bb_upper')}, {r('m - 2 * s', 'bb_lower')}, sum(v) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv, {r('atr')}, {r('sma_5')}, {r('sma_10')}, {r('m', 'sma_20')} FROM pk")
def indicator_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.indicator_pack(hourly(spark, sf_dir)).drop("ts", *VALUES))


@query(f"WITH {H}, g AS (SELECT symbol, bar_idx, CASE WHEN bar_idx % 4 = 2 THEN close END AS x FROM bars) SELECT symbol, bar_idx, last_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward, first_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM g")
def ffill_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.series()
    b = hourly(spark, sf_dir).withColumn("x", F.when(F.col("bar_idx") % 4 == 2, F.col("close")))
    return b.select("symbol", "bar_idx", X.ffill("x", w).alias("forward"), X.bfill("x", w).alias("backward"))


@query(f"WITH {H}, g AS (SELECT symbol, bar_idx, CASE WHEN bar_idx % 4 = 2 THEN close END AS x FROM bars), f AS (SELECT symbol, bar_idx, last_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM g) SELECT * FROM f WHERE x IS NOT NULL")
def ffill_dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hourly(spark, sf_dir).withColumn("x", F.when(F.col("bar_idx") % 4 == 2, F.col("close")))
    return b.select("symbol", "bar_idx", X.ffill("x", X.series()).alias("x")).dropna(subset=["x"])


@query(f"WITH {H}, g AS (SELECT symbol, bar_idx, CASE WHEN bar_idx % 7 = 3 THEN 1 WHEN bar_idx % 11 = 5 THEN -1 ELSE 0 END AS s FROM bars) SELECT symbol, bar_idx, {held('s')} AS position FROM g")
def position_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("bar_idx")
    b = hourly(spark, sf_dir).withColumn("s", F.when(i % 7 == 3, 1).when(i % 11 == 5, -1).otherwise(0))
    return b.select("symbol", "bar_idx", X.hold("s", X.series()).alias("position"))


_MA = f"m AS (SELECT *, round({rolled('avg', 'close', 10)}, 6) AS fast, round({rolled('avg', 'close', 30)}, 6) AS slow FROM bars), m1 AS (SELECT *, lag(fast) OVER ({W}) AS f0, lag(slow) OVER ({W}) AS s0 FROM m)"


@query(f"WITH {H}, {_MA} SELECT symbol, bar_idx, CASE WHEN f0 <= s0 AND fast > slow THEN 1 ELSE -1 END AS cross_ FROM m1 WHERE (f0 <= s0 AND fast > slow) OR (f0 >= s0 AND fast < slow)")
def ma_cross_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.ma_crossover_frame(hourly(spark, sf_dir)).filter(F.col("cross") != 0).select("symbol", "bar_idx", F.col("cross").alias("cross_"))


_AT = f"a AS (SELECT symbol, bar_idx, {rolled('avg', 'tr', 14)} AS atr FROM (SELECT *, {_TR} AS tr FROM bars))"


@query(f"WITH {H}, {_AT} SELECT symbol, bar_idx, {r('atr')}, {r(f'CASE WHEN bar_idx >= 50 THEN avg(atr) OVER ({W} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) ELSE avg(atr) OVER (PARTITION BY symbol) END', 'atr_mean')} FROM a")
def atr_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the 50 values before each; before there are 50, that of the whole series."""
    w = X.series()
    b = hourly(spark, sf_dir).withColumn("tr", I.true_range(w)).withColumn("atr", X.rolling(F.avg, "tr", 14, w))
    from pyspark.sql import Window

    mean = F.when(F.col("bar_idx") >= 50, F.avg("atr").over(w.rowsBetween(-50, -1))).otherwise(F.avg("atr").over(Window.partitionBy("symbol")))
    return rounded(b.select("symbol", "bar_idx", "atr", mean.alias("atr_mean")))


_L = 24


@query(f"WITH {H}, f AS (SELECT *, min(close) OVER ({W} ROWS BETWEEN {_L} PRECEDING AND 1 PRECEDING) AS lo, max(close) OVER ({W} ROWS BETWEEN {_L} PRECEDING AND 1 PRECEDING) AS hi, lag(close) OVER ({W}) AS x FROM bars) SELECT symbol, bar_idx, {r('CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0.0 END', 'last_scaled')} FROM f WHERE bar_idx >= {_L}")
def minmax_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each window of the rows before, scaled to the window's range."""
    f = X.series().rowsBetween(-_L, -1)
    lo, hi = F.min("close").over(f), F.max("close").over(f)
    scaled = F.when(hi > lo, (X.shift("close", X.series()) - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(F.lit(0.0))
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_idx", scaled.alias("last_scaled")).filter(f"bar_idx >= {_L}"))


@query(f"WITH {H}, f AS (SELECT *, list(close) OVER ({W} ROWS BETWEEN {_L} PRECEDING AND 1 PRECEDING) AS xs FROM bars) SELECT symbol, bar_idx, len(xs) AS n, {r('list_sum(list_transform(xs, lambda x: CASE WHEN list_max(xs) > list_min(xs) THEN (x - list_min(xs)) / (list_max(xs) - list_min(xs)) ELSE 0.0 END))', 'scaled_sum', 4)} FROM f WHERE bar_idx >= {_L}")
def feature_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of each bar's look-back, scaled within the window, as a model's input; their sum stands for them."""
    f = X.series().rowsBetween(-_L, -1)
    b = hourly(spark, sf_dir).withColumn("xs", F.collect_list("close").over(f)).filter(f"bar_idx >= {_L}")
    lo, hi = F.array_min("xs"), F.array_max("xs")
    scaled = F.transform("xs", lambda x: F.when(hi > lo, (x - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(F.lit(0.0)))
    return rounded(b.select("symbol", "bar_idx", F.size("xs").cast("long").alias("n"), F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x).alias("scaled_sum")), 4)


@query()
def feature_windows_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaled windows of all features of a model's input; a sum per feature stands for its column."""
    made = folds.feature_windows(folds.indicator_pack(hourly(spark, sf_dir)), _L)
    total = lambda k: F.aggregate("features", F.lit(0.0), lambda a, x: a + x[k])
    return rounded(made.select("symbol", "bar_idx", F.size("features").cast("long").alias("n"), *(total(k).alias(c) for k, c in enumerate(folds.FEATURES))), 4)


@query(f"WITH {H} SELECT symbol, bar_idx, {r(f'100000 * close / first_value(close) OVER ({W})', 'buy_hold')} FROM bars")
def buy_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_idx", (F.lit(100_000.0) * F.col("close") / F.first("close").over(X.series())).alias("buy_hold")))


@query(f"WITH {H}, d AS (SELECT *, coalesce(lag(close) OVER ({W}), open) AS p FROM bars) SELECT symbol, bar_idx, {r('ln(open) - ln(p)', 'r_o', 9)}, {r('ln(high) - ln(open)', 'r_h', 9)}, {r('ln(low) - ln(open)', 'r_l', 9)}, {r('ln(close) - ln(open)', 'r_c', 9)} FROM d")
def log_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(permutation.decompose(hourly(spark, sf_dir)).select("symbol", "bar_idx", "r_o", "r_h", "r_l", "r_c"), 9)


_SIM_RET = f"q AS (SELECT *, CASE WHEN bar_idx = 0 THEN 0.0::DOUBLE ELSE close / lag(close) OVER ({W}) - 1 END AS ret FROM bars), e AS (SELECT *, product(1 + ret) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS curve FROM q)"


@query(f"WITH {H}, {_SIM_RET} SELECT symbol, bar_idx, {r('100000 * curve', 'equity')} FROM e")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.series()
    b = hourly(spark, sf_dir).withColumn("ret", F.coalesce(X.pct_change("close", w), F.lit(0.0)))
    return rounded(b.select("symbol", "bar_idx", (F.lit(100_000.0) * X.growth("ret", w)).alias("equity")))


@query(f"WITH {H}, t AS (SELECT *, max(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM bars) SELECT symbol, bar_idx, {r('top')}, {r('(close - top) / top', 'drawdown')} FROM t")
def drawdown_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.series()
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_idx", X.running_max("close", w).alias("top"), X.top_drawdown("close", w).alias("drawdown")))


def _glob(path: str) -> str:
    """A pattern for path alone: a stream takes a single file only by a pattern."""
    return path[:-1] + "[" + path[-1] + "]"


@query(f"WITH {H} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def streaming_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars by a stream over the events, run until it has seen them all."""
    from ..streaming import live

    batch = table(spark, sf_dir, "events")
    ticks = spark.readStream.schema(batch.schema).parquet(_glob(f"{sf_dir}/events.parquet"))
    made = live.bars(ticks, F.col("event_type"), F.col("ts"), F.lit(1000.0) + F.col("value"), F.col("event_id"))
    return live.drained(made, scratch(spark, "stream"), "complete").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""WITH RECURSIVE n AS (SELECT event_type AS symbol, event_id AS seq, 1000.0::DOUBLE + value AS price, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
e AS (SELECT symbol, seq, i, price AS ema FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.seq, n.i, (1 - 2.0::DOUBLE / 13) * e.ema + 2.0::DOUBLE / 13 * n.price FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
SELECT symbol, seq, {r('ema')} FROM e""")
def streaming_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exponential mean of a stream of ticks with one number of state per symbol."""
    from ..streaming import live

    batch = table(spark, sf_dir, "events")
    ticks = spark.readStream.schema(batch.schema).parquet(_glob(f"{sf_dir}/events.parquet")).select(F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), (F.lit(1000.0) + F.col("value")).alias("price"))
    return rounded(live.drained(live.smoothed(ticks, 12), scratch(spark, "stream"), "append"))
