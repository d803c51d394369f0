"""Many runs over packed series: one row holds the arrays of a series, and tasks are (series, batch of runs).

Series are packed once, so bars are not multiplied by parameters, windows or permutations; within a batch,
runs share indicators. A series must fit in a task's memory, which bars of any practical span do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.metrics import METRICS
from ..operators.permutation import permuted_arrays
from ..operators.strategies import STRATEGIES
from ..schema import VALUES

#: Windows and parameters of a batch of a series' own runs.
WINDOWS, PARAMS = 4, 256
METRIC_SCHEMA = ", ".join(f"{m} double" for m in METRICS)


def pack(bars: DataFrame) -> DataFrame:
    """symbol and one ordered array per value."""
    rows = bars.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("bar_idx", *VALUES))).alias("r"))
    return rows.select("symbol", *[F.col(f"r.{v}").alias(v) for v in VALUES])


def batched(runs: DataFrame, size: int, key: str) -> DataFrame:
    """runs in arrays of about size rows."""
    return runs.withColumn("__b", F.floor(F.col(key) / size)).groupBy("__b").agg(F.collect_list(F.struct(*runs.columns)).alias("runs"))


def evaluate(bars: DataFrame, runs: DataFrame, one: Callable[[dict[str, np.ndarray], dict, dict], Iterator[tuple]], schema: str, size: int = 16, key: str = "param_id") -> DataFrame:
    """symbol and the rows that one(arrays, run, cache) yields for each run and series; cache is shared in a batch."""
    names = [c.split()[0] for c in schema.split(", ")]
    # a row per series and batch of runs: both sides are small tables of packed rows
    tasks = pack(bars).crossJoin(batched(runs, size, key)).withColumn("__t", F.xxhash64("symbol", "__b"))
    tasks = tasks.repartition(F.col("__t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                arrays = {v: np.asarray(getattr(row, v), dtype=np.float64) for v in VALUES}
                cache: dict = {}
                out = [(row.symbol, *r) for x in row.runs for r in one(arrays, x, cache)]
                if out:
                    yield pd.DataFrame(out, columns=["symbol", *names])

    return tasks.select("symbol", *VALUES, "runs").mapInPandas(run, f"symbol string, {schema}")


def score(arrays: dict[str, np.ndarray], strategy: str, params: dict[str, float], cost: float, periods: float, cache: dict | None = None) -> tuple:
    """The metrics of one run and an error; a run that fails has nulls and its error."""
    try:
        signal = STRATEGIES[strategy].signals(arrays, params, cache)
    except ValueError as e:
        return (*[None] * len(METRICS), str(e))
    m = kernels.metrics(kernels.returns(arrays["close"], signal, cost), signal, periods)
    return (*[m[k] for k in METRICS], None)


def as_params(value) -> dict[str, float]:
    return dict(value) if value is not None else {}


def grid_runs(bars: DataFrame, params: DataFrame, strategy: str, cost: float, periods: float) -> DataFrame:
    """Metrics of each (symbol, param_id); params has param_id and a map params."""
    return evaluate(bars, params, lambda a, r, c: iter([(r["param_id"], *score(a, strategy, as_params(r["params"]), cost, periods, c))]), f"param_id int, {METRIC_SCHEMA}, error string")


def window_runs(bars: DataFrame, runs: DataFrame, strategy: str, cost: float, periods: float) -> DataFrame:
    """Metrics of each (symbol, window_id, param_id) on bars [low, high) alone; runs has these, params and, if given, symbol."""
    chosen = "symbol" in runs.columns

    def one(a: dict[str, np.ndarray], r: dict, cache: dict) -> Iterator[tuple]:
        span = (r["low"], r["high"])
        part = {k: v[r["low"] : r["high"]] for k, v in a.items()}
        yield r["window_id"], r["param_id"], *score(part, strategy, as_params(r["params"]), cost, periods, cache.setdefault(span, {}))

    schema = f"window_id int, param_id int, {METRIC_SCHEMA}, error string"
    if not chosen:
        return evaluate(bars, runs, one, schema, 64, "window_id")
    # runs of their own for each series, in batches of a few windows and of parameters
    batch = F.struct(F.floor(F.col("window_id") / WINDOWS), F.floor(F.col("param_id") / PARAMS))
    own = runs.groupBy("symbol", batch.alias("__b")).agg(F.collect_list(F.struct(*[c for c in runs.columns if c != "symbol"])).alias("runs"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                arrays = {v: np.asarray(getattr(row, v), dtype=np.float64) for v in VALUES}
                cache: dict = {}
                yield pd.DataFrame([(row.symbol, *r) for x in row.runs for r in one(arrays, x, cache)], columns=["symbol", *names])

    tasks = pack(bars).join(own, "symbol").withColumn("__t", F.xxhash64("symbol", "__b")).repartition(F.col("__t"))
    return tasks.select("symbol", *VALUES, "runs").mapInPandas(run, f"symbol string, {schema}")


def permutation_runs(bars: DataFrame, seeds: DataFrame, strategy: str, params: list[dict[str, float]], metric: str, cost: float, periods: float, start: int = 0, mode: str = "both", reconstruction: str = "gap_only") -> DataFrame:
    """score of each (symbol, perm_id) under numpy's permutations: the best over params, -Infinity where all fail."""
    at = METRICS.index(metric)

    def one(a: dict[str, np.ndarray], r: dict, _: dict) -> Iterator[tuple]:
        moved = permuted_arrays(a, r["perm_id"], start, mode, reconstruction)
        cache: dict = {}
        scores = [score(moved, strategy, p, cost, periods, cache)[at] for p in params]
        yield r["perm_id"], max((s for s in scores if s is not None), default=float("-inf"))

    return evaluate(bars, seeds, one, "perm_id long, score double", 25, "perm_id")
