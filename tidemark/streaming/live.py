"""Bars and signals from streams of ticks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(ticks: DataFrame, symbol: Column, ts: Column, price: Column, order: Column, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks: tumbling windows of event time; ticks later than late are dropped."""
    t = ticks.select(symbol.alias("symbol"), ts.cast("timestamp").alias("t"), price.alias("p"), order.alias("o")).withWatermark("t", late)
    done = t.groupBy("symbol", F.window("t", width)).agg(F.min_by("p", F.struct("t", "o")).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", F.struct("t", "o")).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return done.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def smoothed(ticks: DataFrame, span: int) -> DataFrame:
    """The exponential mean of price after each (symbol, seq, price) of a stream, with one number of state per symbol.

    Rows of a symbol must come in order of seq from batch to batch; within a batch they are ordered here.
    """
    alpha = 2.0 / (span + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for x in rows["price"].tolist():
            last = x if last is None else (1 - alpha) * last + alpha * x
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({"symbol": key[0], "seq": rows["seq"].to_numpy(), "ema": out})

    return ticks.groupBy("symbol").applyInPandasWithState(step, "symbol string, seq long, ema double", "last double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over what is there now and return its result as a table written under folder."""
    spark: SparkSession = stream.sparkSession
    base = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{base}/out")
        else:
            batch.write.mode("append").parquet(f"{base}/out")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
