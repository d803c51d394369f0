"""The registry of queries, the bars that they run on, and SQL for the same bars."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (session, folder) under its name, with SQL for its rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return B.from_ticks(e, F.col("event_type"), F.col("ts"), F.lit(1000.0) + F.col("value"), ["ts", "event_id"], "hour")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events table with bar_idx: a price of 1000 + value, one symbol per event type."""
    return B.indexed(hourly_ticks(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the orders table with bar_idx: one symbol per priority."""
    o = table(spark, sf_dir, "orders")
    return B.indexed(B.from_ticks(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), ["o_orderkey"], "day"))


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded (infinite ones stay), so that the order of sums doesn't show."""
    return df.select(*[_round(c, special.get(c, digits)) if t == "double" else F.col(c) for c, t in df.dtypes])


def _round(c: str, digits: int) -> Column:
    return F.when(F.abs(F.col(c)) == float("inf"), F.col(c)).otherwise(F.round(F.col(c), digits) + F.lit(0.0)).alias(c)


_H = """
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(1000.0::DOUBLE + value, (ts, event_id)) AS open, max(1000.0::DOUBLE + value) AS high,
         min(1000.0::DOUBLE + value) AS low, arg_max(1000.0::DOUBLE + value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2"""
_D = """
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume
  FROM orders GROUP BY 1, 2"""
_INDEX = "SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS INT) AS bar_idx FROM"
H = f"bars AS ({_INDEX} ({_H}))"
D = f"bars AS ({_INDEX} ({_D}))"
W = "PARTITION BY symbol ORDER BY bar_idx"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL: a rounded number, infinite ones as they are."""
    return f"CASE WHEN abs({expr}) = 'Infinity'::DOUBLE THEN {expr} ELSE round({expr}, {digits}) + 0.0 END AS {name or expr}"


def rolled(f: str, c: str, n: int, w: str = W) -> str:
    """SQL: f over the last n rows, null until n are there."""
    return f"CASE WHEN count({c}) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN {f}({c}) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"


def held(c: str, w: str = W) -> str:
    return f"coalesce(last_value(nullif({c}, 0) IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"


def simulated(source: str, keys: Sequence[str] = ("symbol",), cost: float = 0.0007) -> str:
    """SQL: source (keys, bar_idx, close, signal) with position, cost and ret, as the tables sim_0 and sim."""
    w = f"PARTITION BY {', '.join(keys)} ORDER BY bar_idx"
    return f"""
sim_0 AS (SELECT *, coalesce(lag(signal) OVER ({w}), 0) AS position, lag(close) OVER ({w}) AS close_0 FROM {source}),
sim AS (SELECT *, CASE WHEN bar_idx = 0 THEN 0 ELSE abs(signal - position) END * {cost}::DOUBLE AS cost,
               CASE WHEN bar_idx = 0 THEN 0.0::DOUBLE ELSE coalesce(position * (close / close_0 - 1) - abs(signal - position) * {cost}::DOUBLE, 0.0::DOUBLE) END AS ret FROM sim_0)"""


#: SQL for the metrics, over the tables of metric_tables().
METRIC_SQL = {
    "total_return": "product(1 + ret) - 1", "annualized_return": "pow(1 + avg(ret), {p}) - 1", "volatility": "stddev_samp(ret) * sqrt({p}::DOUBLE)",
    "sharpe_ratio": "CASE WHEN stddev_samp(ret) * sqrt({p}::DOUBLE) > 0 THEN (pow(1 + avg(ret), {p}) - 1) / (stddev_samp(ret) * sqrt({p}::DOUBLE)) ELSE 0.0::DOUBLE END",
    "max_drawdown": "min((curve - top) / top)", "calmar_ratio": "CASE WHEN min((curve - top) / top) <> 0 THEN (pow(1 + avg(ret), {p}) - 1) / abs(min((curve - top) / top)) ELSE 0.0::DOUBLE END",
    "win_rate": "count(*) FILTER (ret > 0) / count(ret)", "avg_win": "coalesce(avg(ret) FILTER (ret > 0), 0.0::DOUBLE)", "avg_loss": "coalesce(avg(ret) FILTER (ret < 0), 0.0::DOUBLE)",
    "profit_factor": "CASE WHEN coalesce(sum(ret) FILTER (ret < 0), 0) < 0 THEN coalesce(sum(ret) FILTER (ret > 0), 0) / -sum(ret) FILTER (ret < 0) WHEN coalesce(sum(ret) FILTER (ret > 0), 0) > 0 THEN 'Infinity'::DOUBLE ELSE 0.0::DOUBLE END",
    "total_trades": "count(*) FILTER (before IS NULL OR signal <> before)", "winning_trades": "count(*) FILTER (ret > 0)", "losing_trades": "count(*) FILTER (ret < 0)",
}
COUNTS = ("total_trades", "winning_trades", "losing_trades")


def metric_tables(keys: Sequence[str] = ("symbol",), source: str = "sim") -> str:
    w = f"PARTITION BY {', '.join(keys)} ORDER BY bar_idx"
    run = f"{w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
met_0 AS (SELECT *, product(1 + ret) OVER ({run}) AS curve, lag(signal) OVER ({w}) AS before FROM {source}),
met AS (SELECT *, max(curve) OVER ({run}) AS top FROM met_0)"""


def metric_columns(periods: float = 252, only: Sequence[str] | None = None, digits: int = 6) -> str:
    return ", ".join(f"{s} AS {m}" if m in COUNTS else r(s.format(p=periods), m, digits) for m, s in METRIC_SQL.items() if only is None or m in only)


def ma_signals(source: str, short: str, long: str, keys: Sequence[str] = ("symbol",), name: str = "sig") -> str:
    """SQL: source with the crossover signal of two fixed means, as the table name."""
    w = f"PARTITION BY {', '.join(keys)} ORDER BY bar_idx"
    return f"""
{name}_0 AS (SELECT *, round({rolled('avg', 'close', int(short), w)}, 6) AS fast, round({rolled('avg', 'close', int(long), w)}, 6) AS slow FROM {source}),
{name}_1 AS (SELECT *, lag(fast) OVER ({w}) AS f0, lag(slow) OVER ({w}) AS s0 FROM {name}_0),
{name}_2 AS (SELECT *, CASE WHEN f0 <= s0 AND fast > slow THEN 1 WHEN f0 >= s0 AND fast < slow THEN -1 ELSE 0 END AS cross_ FROM {name}_1),
{name} AS (SELECT *, {held('cross_', w)} AS signal FROM {name}_2)"""
