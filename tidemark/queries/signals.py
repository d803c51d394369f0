"""Queries: strategies, back-tests and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import windows as X
from ..operators import backtest, folds, portfolio, strategies
from ..plans import report
from .base import D, H, METRIC_SQL, W, daily, held, hourly, ma_signals, metric_columns, metric_tables, query, r, rolled, rounded, simulated
from .series import _PACK, REC

_MA = ma_signals("bars", "10", "30")


def _ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.ma_crossover_frame(hourly(spark, sf_dir), 10, 30)


@query(f"WITH {H}, {_MA}, {simulated('sig')}, {metric_tables()} SELECT symbol, {metric_columns()} FROM met GROUP BY symbol")
def strategy_ma_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, signals, back-test and the 13 metrics of each symbol."""
    return rounded(backtest.run(_ma(spark, sf_dir)))


def _signal_query(name: str, sql: str, make) -> None:
    """A query of a strategy's signals."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(hourly(spark, sf_dir)).select("symbol", "bar_idx", F.col("signal").cast("int").alias("signal"))

    f.__name__ = name
    query(sql)(f)


_CH = f"count(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20"
_signal_query(
    "strategy_donchian",
    f"WITH {H}, c AS (SELECT *, CASE WHEN {_CH} THEN max(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS hi, CASE WHEN {_CH} THEN min(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS lo FROM bars), s AS (SELECT *, CASE WHEN close < lo THEN -1 WHEN close > hi THEN 1 ELSE 0 END AS raw FROM c) SELECT symbol, bar_idx, {held('raw')} AS signal FROM s",
    strategies.donchian_frame,
)
_signal_query("strategy_sma_state", f"WITH {H}, c AS (SELECT *, round({rolled('avg', 'close', 20)}, 6) AS m FROM bars) SELECT symbol, bar_idx, CASE WHEN close > m THEN 1 WHEN close < m THEN -1 ELSE 0 END AS signal FROM c", strategies.sma_state_frame)
_signal_query("strategy_ma_state", f"WITH {H}, c AS (SELECT *, round({rolled('avg', 'close', 10)}, 6) AS f, round({rolled('avg', 'close', 20)}, 6) AS m FROM bars) SELECT symbol, bar_idx, CASE WHEN f > m THEN 1 WHEN f < m THEN -1 ELSE 0 END AS signal FROM c", strategies.ma_state_frame)
_TR = f"greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W})))"
_signal_query(
    "ma_atr_filter",
    f"WITH {H}, t AS (SELECT *, {_TR} AS tr FROM bars), a AS (SELECT *, round({rolled('avg', 'close', 10)}, 6) AS f, round({rolled('avg', 'close', 30)}, 6) AS m, round({rolled('avg', 'tr', 14)}, 6) AS atr FROM t), b AS (SELECT *, round({rolled('avg', 'atr', 50)}, 6) AS am FROM a) SELECT symbol, bar_idx, CASE WHEN atr > am AND f > m THEN 1 WHEN atr > am AND f < m THEN -1 ELSE 0 END AS signal FROM b",
    strategies.ma_atr_filter_frame,
)


def _before(x: str, fill: bool = True) -> str:
    """SQL: the rounded value of the bar before; the leading gap gets the first value there is."""
    return f"coalesce(lag(round({x}, 6)) OVER ({W}), first_value(round({x}, 6) IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


def _now(x: str) -> str:
    """SQL: the rounded value; the leading gap gets the first value there is."""
    return f"coalesce(round({x}, 6), first_value(round({x}, 6) IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


def _automaton(inputs: str, up: str, down: str, width: str, start: int, side: int = 1) -> str:
    """SQL: the states of an automaton with a stop that is set on entry."""
    op = ("-", "+") if side == 1 else ("+", "-")
    return f"""
inp AS ({inputs}),
aut AS (
  SELECT symbol, bar_idx, 0 AS signal, 0.0::DOUBLE AS stop FROM inp WHERE bar_idx = 0
  UNION ALL
  SELECT i.symbol, i.bar_idx,
    CASE WHEN i.bar_idx < {start} THEN 0
         WHEN p.signal = 0 THEN CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END
         WHEN p.signal = 1 AND i.close < p.stop OR p.signal = -1 AND i.close > p.stop THEN 0 ELSE p.signal END,
    CASE WHEN i.bar_idx >= {start} AND p.signal = 0 THEN CASE WHEN {up} THEN i.close {op[0]} {width} WHEN {down} THEN i.close {op[1]} {width} ELSE 0 END ELSE p.stop END
  FROM aut p JOIN inp i ON i.symbol = p.symbol AND i.bar_idx = p.bar_idx + 1
)
SELECT symbol, bar_idx, signal FROM aut"""


_BANDS = f"bd AS (SELECT *, {rolled('avg', 'close', 20)} AS m, {rolled('stddev_pop', 'close', 20)} AS sd FROM full_)"


def _fold_query(name: str, strategy: str, tail: str) -> None:
    _signal_query(name, f"WITH RECURSIVE {H}, {REC}, {_BANDS}, {tail}", lambda b: folds.signals(b, strategy))


_fold_query("strategy_bb_atr", "bb_atr", _automaton(f"SELECT symbol, bar_idx, close, {_before('m + 2 * sd')} AS hi, {_before('m - 2 * sd')} AS lo, {_before('atr')} AS a FROM bd", "i.close > i.hi", "i.close < i.lo", "2.0::DOUBLE * i.a", 21, -1))
_fold_query("strategy_macd_atr", "macd_atr", _automaton(f"SELECT symbol, bar_idx, close, {_before('macd')} AS l, {_before('macd_signal')} AS s, {_before('atr')} AS a FROM bd", "i.l > i.s", "i.l < i.s", "2.0::DOUBLE * i.a", 31))
_fold_query("strategy_rsi_atr", "rsi_atr", _automaton(f"SELECT symbol, bar_idx, close, {_before('rsi')} AS x, {_before('atr')} AS a FROM bd", "i.x > 60", "i.x < 40", "2.0::DOUBLE * i.a", 15))
_fold_query("strategy_sma_atr", "sma_atr", _automaton(f"SELECT symbol, bar_idx, close, {_before('m')} AS s, {_before('atr')} AS a FROM bd", "i.close > i.s", "i.close < i.s", "2.0::DOUBLE * i.a", 25))
_fold_query(
    "strategy_multi_indicator", "multi_indicator",
    f"""inp AS (SELECT symbol, bar_idx, close, {_now('rsi')} AS x, {_now('m')} AS s, {_now('macd')} AS l, {_now('macd_signal')} AS g FROM bd),
con AS (SELECT *, x > 55 AND close > s AND l > g AS up, x < 45 AND close < s AND l < g AS down, x < 40 OR close < round(s * 0.98::DOUBLE, 6) OR l < g AS off_long, x > 60 OR close > round(s * 1.02::DOUBLE, 6) OR l > g AS off_short FROM inp),
aut AS (SELECT symbol, bar_idx, 0 AS signal FROM con WHERE bar_idx = 0
  UNION ALL SELECT c.symbol, c.bar_idx, CASE WHEN c.bar_idx < 31 THEN 0 WHEN p.signal = 0 THEN CASE WHEN c.up THEN 1 WHEN c.down THEN -1 ELSE 0 END WHEN p.signal = 1 AND c.off_long OR p.signal = -1 AND c.off_short THEN 0 ELSE p.signal END
  FROM aut p JOIN con c ON c.symbol = p.symbol AND c.bar_idx = p.bar_idx + 1)
SELECT symbol, bar_idx, signal FROM aut""",
)


@query(f"WITH {H}, {_MA}, {simulated('sig')} SELECT symbol, signal, count(*) AS n FROM sim GROUP BY 1, 2")
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ma(spark, sf_dir).groupBy("symbol", F.col("signal").cast("int").alias("signal")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {H}, {_MA}, {simulated('sig')} SELECT symbol, bar_idx, signal, position, {r('cost', 'cost', 9)}, {r('ret', 'ret', 9)} FROM sim")
def backtest_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = backtest.simulate(_ma(spark, sf_dir))
    return rounded(df.select("symbol", "bar_idx", F.col("signal").cast("int").alias("signal"), F.col("position").cast("int").alias("position"), "cost", "ret"), 9)


@query(f"WITH {D}, {ma_signals('bars', '5', '20')}, {simulated('sig', cost=0.0025)}, {metric_tables()} SELECT symbol, {metric_columns(365, ('win_rate', 'avg_win', 'avg_loss', 'total_trades', 'winning_trades', 'losing_trades', 'profit_factor'))} FROM met GROUP BY symbol")
def metrics_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily run with the drivers' costs and year; prices of orders jump, so compounded figures are left out."""
    done = backtest.run(strategies.ma_crossover_frame(daily(spark, sf_dir), 5, 20), cost=0.0025, periods=365)
    return rounded(done.select("symbol", "win_rate", "avg_win", "avg_loss", "total_trades", "winning_trades", "losing_trades", "profit_factor"))


def _metric_query(metric: str) -> None:
    """A metric on its own, of a series held all the time."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = X.series()
        df = hourly(spark, sf_dir).withColumn("ret", F.coalesce(X.pct_change("close", w), F.lit(0.0))).withColumn("signal", F.lit(1))
        return rounded(M.summarise(df, ["symbol"], 252).select("symbol", metric))

    f.__name__ = f"metric_{metric}"
    query(f"WITH {H}, sim AS (SELECT *, 1 AS signal, coalesce(close / lag(close) OVER ({W}) - 1, 0) AS ret FROM bars), {metric_tables()} SELECT symbol, {r(METRIC_SQL[metric].format(p=252), metric)} FROM met GROUP BY symbol")(f)


for _m in ("profit_factor", "sharpe_ratio", "max_drawdown", "calmar_ratio"):
    _metric_query(_m)

_EQ = f"cur AS (SELECT *, 100000 * product(1 + ret) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity, 100000 * close / first_value(close) OVER ({W}) AS buy_hold FROM sim), cur2 AS (SELECT *, max(equity) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM cur)"


@query(f"WITH {H}, {_MA}, {simulated('sig')}, {_EQ} SELECT symbol, bar_idx, {r('equity', digits=4)}, {r('buy_hold', digits=4)}, {r('(equity - top) / top', 'drawdown')}, CASE WHEN signal <> position AND signal = 1 THEN 'long' WHEN signal <> position AND signal = -1 THEN 'short' END AS marker FROM cur2")
def report_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table behind a back-test chart."""
    df = report.backtest_curves(_ma(spark, sf_dir))
    return rounded(df.select("symbol", "bar_idx", "equity", "buy_hold", "drawdown", "marker"), 4, drawdown=6)


@query(f"""WITH {H}, {_MA}, {simulated('sig')}, {_EQ}, q AS (SELECT *, equity / lag(equity) OVER ({W}) - 1 AS cr FROM cur2)
SELECT symbol, {r('(arg_max(equity, bar_idx) - arg_min(equity, bar_idx)) / arg_min(equity, bar_idx) * 100', 'total_return_pct')},
  {r('CASE WHEN stddev_samp(cr) > 0 THEN (avg(cr) - (pow(1.02::DOUBLE, 1 / 8760.0::DOUBLE) - 1)) / stddev_samp(cr) * sqrt(8760.0::DOUBLE) ELSE 0.0 END', 'sharpe_ratio')},
  {r('max((top - equity) / top)', 'max_drawdown')}, {r('(arg_max(equity, bar_idx) - arg_min(equity, bar_idx)) / arg_min(equity, bar_idx) * 100 / max((top - equity) / top)', 'return_to_drawdown')}
FROM q GROUP BY symbol""")
def capital_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.capital_metrics(backtest.simulate(_ma(spark, sf_dir))))


@query()
def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as JSON with null for infinite numbers."""
    return report.summary_json(rounded(backtest.run(_ma(spark, sf_dir))))


_PF = f"""
pf_0 AS (SELECT *, ('0x' || substr(md5(symbol || ':' || bar_idx), 1, 4))::BIGINT / 65536.0::DOUBLE AS buy FROM pk WHERE rsi IS NOT NULL AND macd IS NOT NULL AND macd_signal IS NOT NULL AND m IS NOT NULL),
pf_1 AS (SELECT symbol, bar_idx, row_number() OVER ({W}) - 1 AS i, close AS c, atr AS a, sma_5 AS s5, sma_10 AS s10, m AS s20, rsi AS x, macd AS l, macd_signal AS g, buy, 1 - buy AS sell FROM pf_0),
pf_2 AS (SELECT *, CASE WHEN i >= 50 THEN avg(a) OVER ({W} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) ELSE avg(a) OVER (PARTITION BY symbol) END AS am,
  x > 60 OR c > s10 OR c > s5 OR l > g AS strong, x < 40 OR c < s10 OR c < s5 OR l < g AS weak FROM pf_1),
inp AS (SELECT *, c <> 0 AND a <> 0 AND NOT a < 0.05::DOUBLE * am AS ok, (buy >= 0.6::DOUBLE OR strong) AND (strong OR c > s20 * 0.995::DOUBLE) AS up, (sell >= 0.6::DOUBLE OR weak) AND (weak OR c < s20 * 1.005::DOUBLE) AS down FROM pf_2),
acc AS (
  SELECT symbol, -1::BIGINT AS i, 0.0::DOUBLE AS c, 100000.0::DOUBLE AS cash, 0 AS side, 0.0::DOUBLE AS q, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS stop, 0.0::DOUBLE AS trail, 0 AS held, 0::BIGINT AS trades FROM inp WHERE i = 0
  UNION ALL
  SELECT symbol, i, c, CASE WHEN off THEN cash + side * q * out_ - q * out_ * 0.001::DOUBLE ELSE cash END, CASE WHEN off THEN 0 ELSE side END, CASE WHEN off THEN 0 ELSE q END,
         CASE WHEN off THEN 0 ELSE entry END, CASE WHEN off THEN 0 ELSE stop END, CASE WHEN off THEN 0 ELSE trail END, CASE WHEN off THEN 0 ELSE held END, trades
  FROM (SELECT *, why IS NOT NULL AS off, CASE WHEN why = 'time' THEN c ELSE c * (1 - side * 0.001::DOUBLE) END AS out_
  FROM (SELECT *, CASE WHEN NOT ok OR side = 0 THEN NULL WHEN side * (c - stop) <= 0 THEN 'stop' WHEN side * (trail - stop) > 0 AND side * (c - trail) <= 0 THEN 'trail'
          WHEN side * (c - entry) >= a * (2.0::DOUBLE * CASE WHEN a > am THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) THEN 'take' WHEN held > 72 THEN 'time' END AS why
  FROM (SELECT symbol, i, c, a, am, ok, CASE WHEN way <> 0 THEN cash - way * want * at_ - want * at_ * 0.001::DOUBLE ELSE cash END AS cash, CASE WHEN way <> 0 THEN way ELSE side END AS side,
          CASE WHEN way <> 0 THEN want ELSE q END AS q, CASE WHEN way <> 0 THEN at_ ELSE entry END AS entry, CASE WHEN way <> 0 THEN at_ - way * a * 0.5::DOUBLE ELSE stop END AS stop,
          CASE WHEN way <> 0 THEN at_ - way * a * 0.5::DOUBLE ELSE trail END AS trail, CASE WHEN way <> 0 THEN 1 ELSE held END AS held, trades + abs(way) AS trades
  FROM (SELECT *, CASE WHEN side_ <> 0 AND want > 0 AND cash >= CASE WHEN side_ = 1 THEN want * at_ + want * at_ * 0.001::DOUBLE ELSE want * at_ * 0.001::DOUBLE END THEN side_ ELSE 0 END AS way
  FROM (SELECT *, c * (1 + side_ * 0.001::DOUBLE) AS at_, least(least(cash * 0.005::DOUBLE / (a * 0.5::DOUBLE), cash * 0.02::DOUBLE / a), cash * 0.15::DOUBLE / c) AS want
  FROM (SELECT n.symbol, n.i, n.c, n.a, n.am, n.ok, p.cash, p.side, p.q, p.entry, p.trades, p.held + CASE WHEN n.ok AND p.side <> 0 THEN 1 ELSE 0 END AS held,
          CASE WHEN n.ok AND p.side = 0 AND p.cash > 0 THEN CASE WHEN n.up THEN 1 WHEN n.down THEN -1 ELSE 0 END ELSE 0 END AS side_,
          CASE WHEN n.ok AND p.side <> 0 AND p.side * (n.c - p.entry) > n.a * 0.3::DOUBLE THEN CASE WHEN p.side = 1 THEN greatest(p.stop, p.entry) ELSE least(p.stop, p.entry) END ELSE p.stop END AS stop,
          CASE WHEN n.ok AND p.side <> 0 AND p.side * (n.c - p.entry) > n.a * 0.3::DOUBLE THEN CASE WHEN p.side = 1 THEN greatest(p.trail, n.c * (1 - 0.05::DOUBLE)) ELSE least(p.trail, n.c * (1 + 0.05::DOUBLE)) END ELSE p.trail END AS trail
        FROM acc p JOIN inp n ON n.symbol = p.symbol AND n.i = p.i + 1))))))
)"""


@query(f"WITH RECURSIVE {H}, {REC}, {_PACK}, {_PF} SELECT n.symbol, n.bar_idx, {r('cash + CASE WHEN side = 1 THEN q * a.c WHEN side = -1 THEN q * (2 * entry - a.c) ELSE 0 END', 'capital', 4)}, trades FROM acc a JOIN inp n ON n.symbol = a.symbol AND n.i = a.i")
def portfolio_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account of the portfolio simulator with fixed probabilities in place of a model's."""
    pack = folds.indicator_pack(hourly(spark, sf_dir))
    score = F.conv(F.substring(F.md5(F.concat_ws(":", "symbol", "bar_idx")), 1, 4), 16, 10).cast("double") / 65536
    ready = pack.dropna(subset=["rsi", "macd", "macd_signal", "sma_20"]).withColumns({"buy": score, "sell": 1 - score})
    return rounded(portfolio.portfolio(ready, portfolio.Rules(confidence=0.6)), 4)


@query(f"WITH {H}, c AS (SELECT *, round({rolled('avg', 'close', 20)}, 6) AS m FROM bars) SELECT symbol, bar_idx, CASE WHEN close > m THEN 1 WHEN close < m THEN -1 ELSE 0 END AS signal FROM c")
def custom_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's pandas function as a strategy."""
    return folds.custom_signals(hourly(spark, sf_dir), _user_strategy, {"period": 20}).select("symbol", "bar_idx", "signal")


def _user_strategy(df, period: int):
    mean = df["close"].rolling(period).mean().round(6)
    return (df["close"] > mean).astype(int) - (df["close"] < mean).astype(int)
