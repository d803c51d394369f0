"""Bars in files: scans, the choice of the latest file, writers."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.bars import date_range
from ..schema import BARS, VALUES, cleaned

TIMEFRAMES = ("1h", "1d")


def check_timeframe(timeframe: str) -> None:
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"timeframe must be one of {', '.join(TIMEFRAMES)}")


def scan(spark: SparkSession, path: str, fmt: str = "parquet", start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from Parquet or CSV; the range of dates goes to the scan as a filter."""
    reader = spark.read.schema(BARS)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
    df = cleaned(df)
    return date_range(df, start, end) if start and end else df


def latest_file(spark: SparkSession, folder: str, symbol: str, timeframe: str) -> str | None:
    """The newest of the files {symbol}_{timeframe}_*.csv in a folder, or None."""
    check_timeframe(timeframe)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{symbol}_{timeframe}_*.csv")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    newest = max(found, key=lambda s: (s.getModificationTime(), s.getPath().getName()), default=None)
    return newest.getPath().toString() if newest else None


def load_local(spark: SparkSession, folder: str, symbol: str, timeframe: str, start: str | None = None, end: str | None = None) -> DataFrame | None:
    """Bars of the newest file, or None where there is none or no bar in the range."""
    path = latest_file(spark, folder, symbol, timeframe)
    if not path:
        return None
    raw = spark.read.option("header", True).csv(path)
    df = cleaned(raw.select(F.lit(symbol).alias("symbol"), F.expr("try_to_timestamp(timestamp)").cast("timestamp_ntz").alias("ts"), *VALUES))
    df = date_range(df, start, end) if start and end else df
    return None if df.isEmpty() else df


def load(spark: SparkSession, folder: str, symbol: str, timeframe: str, start: str | None = None, end: str | None = None, fetch: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Bars of a local file, else what fetch gives; ValueError without either."""
    df = load_local(spark, folder, symbol, timeframe, start, end)
    if df is not None:
        return df
    if fetch is None:
        raise ValueError(f"no bars of {symbol} {timeframe} in {folder} and nothing to fetch them with")
    return fetch()


def save_bars(bars: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Bars by symbol; CSV has ISO timestamps with an offset."""
    if fmt == "csv":
        bars = bars.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+0000'"))
        bars.write.mode(mode).option("header", True).csv(path)
    else:
        bars.write.mode(mode).partitionBy("symbol").parquet(path)


def save_run(path: str, **tables: DataFrame) -> None:
    """Tables of a run (summary, curves, results) as folders under path: JSON for the summary, CSV for flat tables."""
    for name, df in tables.items():
        if name == "summary":
            df.write.mode("overwrite").json(f"{path}/{name}")
        else:
            flat = [c for c, t in df.dtypes if not t.startswith(("array", "struct", "map"))]
            df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def save_backtest(path: str, metrics: DataFrame, curve: DataFrame) -> None:
    """The files of a back-test: backtest_summary, equity_curve, returns and backtest_data (bars with signals)."""
    save_run(path, summary=metrics)
    for name, values in {"equity_curve": ("equity",), "returns": ("ret",), "backtest_data": ("close", "signal", "ret", "equity")}.items():
        save_run(path, **{name: curve.select("symbol", "ts", *values)})


def save_optimisation(path: str, results: DataFrame) -> None:
    """The files of a grid: the best run of each series as summary, and optimization_results with all runs."""
    save_run(f"{path}/optimization", summary=results.filter("rank = 1"), optimization_results=results)


def save_permutations(path: str, statistics: DataFrame, scores: DataFrame) -> None:
    """The files of a permutation test: its statistics as summary, and permutation_scores."""
    save_run(f"{path}/mcpt", summary=statistics, permutation_scores=scores)


def save_walkforward(path: str, summary: DataFrame, results: DataFrame, windows: DataFrame, params: DataFrame) -> None:
    """The files of a walk-forward: its roll-up as summary, walkforward_results, windows, and window_params with the parameters that were best."""
    chosen = results.select("symbol", "window_id", "param_id").join(params, "param_id")
    save_run(f"{path}/walkforward", summary=summary, walkforward_results=results, windows=windows, window_params=chosen)


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options["table"].replace('"', '""'), int(options.get("partitions", 8))

    def _rows(self, sql: str, *values: int) -> list[tuple]:
        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            return db.execute(sql, values).fetchall()

    def partitions(self) -> list[_Rows]:
        low, high = self._rows(f'SELECT min(rowid), max(rowid) FROM "{self.table}"')[0]
        if low is None:
            return [_Rows(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Rows(at, min(at + step, high + 1)) for at in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        yield from self._rows(f'SELECT CAST(timestamp AS TEXT), open, high, low, close, volume FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', partition.low, partition.high)


class SqliteSource(DataSource):
    """spark.read.format("sqlite_bars") with options path (a file that executors see), table and partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_bars"

    def schema(self) -> str:
        return "timestamp string, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options)


def scan_sqlite(spark: SparkSession, path: str, table: str, symbol: str, partitions: int = 8) -> DataFrame:
    """Bars of a table of an SQLite file, read by ranges of row numbers."""
    spark.dataSource.register(SqliteSource)
    raw = spark.read.format("sqlite_bars").options(path=path, table=table, partitions=str(partitions)).load()
    return cleaned(raw.select(F.lit(symbol).alias("symbol"), F.expr("try_to_timestamp(timestamp)").cast("timestamp_ntz").alias("ts"), *VALUES))
