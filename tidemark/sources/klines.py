"""Candles of an exchange as a Spark data source: one partition per span of time, decoded from JSON pages."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from functools import partial
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Days in a span by interval, and the milliseconds of a candle.
CHUNK_DAYS = {"1h": 365, "1d": 1000}
STEP_MS = {"1h": 3_600_000, "1d": 86_400_000}
DAY_MS = 86_400_000
# Names under which payloads carry a candle's fields.
ALIASES = {"ts": ("start", "t", "open_time", "timestamp"), "open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "c"), "volume": ("volume", "vol", "v", "trade_count")}


def to_millis(value: str | int | datetime) -> int:
    """Milliseconds since 1970; a time without a zone is UTC."""
    if isinstance(value, int):
        return value
    t = datetime.fromisoformat(value) if isinstance(value, str) else value
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp() * 1000)


def chunks(start: int, end: int, days: int) -> list[tuple[int, int]]:
    """Spans of at most days from start to end; neighbours share an end point."""
    if start >= end:
        raise ValueError("start must be before end")
    out, at = [], start
    while at < end:
        out.append((at, min(end, at + days * DAY_MS)))
        at = out[-1][1]
    return out


def rows_of(payload: dict | list) -> list:
    """The candles in a payload; ValueError for a code other than 0."""
    if isinstance(payload, dict):
        if payload.get("retCode", 0) not in (0, "0", None):
            raise ValueError(f"the exchange says {payload.get('retMsg')}")
        result = payload.get("result")
        payload = result.get("list") or result.get("data") or [] if isinstance(result, dict) else payload.get("data") or payload.get("list") or []
    return payload


def candle(row: dict | list) -> tuple[int, float, float, float, float, float] | None:
    """(ms, open, high, low, close, volume) of a positional or named candle; None if a field is missing or no number.

    A named candle without a volume has 0.
    """
    try:
        if isinstance(row, dict):
            row = [next((row[k] for k in names if row.get(k) is not None), 0.0 if f == "volume" else None) for f, names in ALIASES.items()]
        return (int(float(row[0])), *(float(x) for x in row[1:6]))
    except (StopIteration, ValueError, TypeError, IndexError):
        return None


def pages(fetch: Callable[[str, str, int, int, int], dict | list], symbol: str, interval: str, start: int, end: int, limit: int = 1000, tries: int = 3, pause: float = 0.0) -> Iterator[tuple]:
    """The candles from start to end, from pages that come newest first: each page ends before the last one's oldest."""
    at = end
    while at >= start:
        for n in range(tries):
            try:
                got = fetch(symbol, interval, start, at, limit)
                break
            except TimeoutError:
                if n == tries - 1:
                    raise
                time.sleep(pause)
        made = [c for c in map(candle, rows_of(got)) if c]
        if not made:
            return
        yield from (c for c in made if start <= c[0] <= end)
        oldest = min(c[0] for c in made)
        if oldest - 1 >= at:
            return
        at = oldest - 1


# The exchange's codes of intervals, and its page of candles.
INTERVAL_CODES = {"1h": "60", "1d": "D"}
ENDPOINT = "https://api.bybit.com/v5/market/kline"


def http(symbol: str, interval: str, start: int, end: int, limit: int, endpoint: str = ENDPOINT, category: str = "linear", seconds: float = 15) -> dict | list:
    """A page of candles from the exchange; a request that takes too long is a TimeoutError, which pages() tries again."""
    asked = {"category": category, "symbol": symbol, "interval": INTERVAL_CODES[interval], "start": start, "end": end, "limit": limit}
    request = urllib.request.Request(f"{endpoint}?{urllib.parse.urlencode(asked)}", headers={"User-Agent": "Mozilla/5.0"})
    try:
        with urllib.request.urlopen(request, timeout=seconds) as got:
            return json.loads(got.read().decode())
    except urllib.error.URLError as e:
        if isinstance(e.reason, TimeoutError):
            raise TimeoutError(str(e)) from e
        raise


def offline(symbol: str, interval: str, start: int, end: int, limit: int) -> dict:
    """A page that an exchange could give, from a formula: for tests and machines without a network."""
    step = STEP_MS[interval]
    last = end // step
    first = max(-(-start // step), last - limit + 1)
    price = lambda i: 100 + i * 7919 % 1000 / 10
    return {"retCode": 0, "result": {"list": [[str(i * step), str(price(i)), str(price(i) + 2), str(price(i) - 2), str(price(i + 1) if abs(price(i + 1) - price(i)) <= 2 else price(i)), str(i % 50)] for i in range(last, first - 1, -1)]}}


class Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class KlineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.symbol, self.interval = options.get("symbol", "BTCUSDT"), options.get("interval", "1h")
        if self.interval not in STEP_MS:
            raise ValueError("interval must be 1h or 1d")
        self.start, self.end = to_millis(options["start"]), to_millis(options["end"])
        self.fetch = options.get("fetch", "tidemark.sources.klines:http")
        self.limit, self.pause = int(options.get("limit", 1000)), float(options.get("pause", 0.15))
        self.more = {k: options[k] for k in ("endpoint", "category") if options.get(k)}

    def partitions(self) -> list[Span]:
        return [Span(a, b) for a, b in chunks(self.start, self.end, CHUNK_DAYS[self.interval])]

    def read(self, partition: Span) -> Iterator[tuple]:
        module, name = self.fetch.split(":")
        fetch = partial(getattr(import_module(module), name), **self.more)
        for ms, *values in pages(fetch, self.symbol, self.interval, partition.start, partition.end, self.limit, pause=self.pause):
            yield self.symbol, datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None), *values


class KlineSource(DataSource):
    """spark.read.format("klines") with options symbol, interval, start, end, limit, endpoint, category, pause (seconds
    before another try), and fetch ("module:function"; the exchange's own page where it is not given)."""

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> KlineReader:
        return KlineReader(self.options)


def read(spark: SparkSession, **options: object) -> DataFrame:
    """Bars of the source without the candles that neighbouring spans share, in no order."""
    spark.dataSource.register(KlineSource)
    df = spark.read.format("klines").options(**{k: str(v) for k, v in options.items()}).load()
    return df.groupBy("symbol", "ts").agg(*[F.min(c).alias(c) for c in ("open", "high", "low", "close", "volume")])


def decode(payload: Column) -> Column:
    """An array of candles from a JSON page column, by built-in functions, as rows_of() and candle() take them.

    Candles are named or positional, at the top, under data or list, or under these in result; those with a missing
    field are left out, a named one without a volume has 0, and a code other than 0 is an error.
    """
    inner = "list:array<string>,data:array<string>"
    page = F.from_json(payload, f"struct<retCode:string,retMsg:string,{inner},result:struct<{inner}>>")
    rows = F.coalesce(page["result"]["list"], page["result"]["data"], page["data"], page["list"], F.from_json(payload, "array<string>"))
    refused = F.coalesce(page["retCode"], F.lit("0")) != "0"
    rows = F.when(refused, F.raise_error(F.concat(F.lit("the exchange says "), F.coalesce(page["retMsg"], F.lit(""))))).otherwise(rows)
    names = "struct<" + ",".join(f"{f}:string" for f in sorted({a for x in ALIASES.values() for a in x})) + ">"

    def one(row: Column) -> Column:
        named, placed = F.from_json(row, names), F.from_json(row, "array<string>")
        field = lambda i, k: F.when(row.startswith("["), F.get(placed, F.lit(i))).otherwise(F.coalesce(*[named[a] for a in ALIASES[k]], *([F.lit("0")] if k == "volume" else [])))
        number = lambda i, k: field(i, k).try_cast("double").cast("long") if k == "ts" else field(i, k).try_cast("double")
        return F.struct(*[number(i, k).alias(k) for i, k in enumerate(ALIASES)])

    whole = lambda c: F.forall(F.array(*[c[k].isNotNull() for k in ALIASES]), lambda x: x)
    return F.filter(F.transform(rows, one), whole)


def as_json(rows: list[dict]) -> str:
    return json.dumps({"retCode": 0, "result": {"list": rows}})
