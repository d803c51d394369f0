"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

REPEATS = 3


def session(cpus: str) -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workloads(spark: SparkSession, d: str) -> dict[str, object]:
    """Name of each workload: a function that gives its result. Sizes follow the published figures."""
    from tidemark.operators import strategies
    from tidemark.plans import grid, mcpt, walkforward
    from tidemark.queries import base, plans, signals

    bars = base.hourly(spark, d)
    one = {"short": [5.0 + i for i in range(100)], "long": [200.0]}
    two = {"short": [5.0 + 2 * i for i in range(20)], "long": [60.0 + 5 * i for i in range(20)]}
    return {
        "single_backtest": lambda: signals.strategy_ma_crossover(spark, d),
        "strategy_rsi_atr": lambda: base.QUERIES["strategy_rsi_atr"](spark, d),
        "grid_100": lambda: grid.search(bars, grid.expand(spark, one), "ma_crossover"),
        "grid_400": lambda: grid.search(bars, grid.expand(spark, two), "ma_crossover"),
        "grid_400_stop_automaton": lambda: grid.search(bars, grid.expand(spark, {"rsi_window": [7.0, 14.0, 21.0, 28.0], "rsi_long": [55.0, 60.0, 65.0, 70.0, 75.0], "rsi_short": [25.0, 30.0, 35.0, 40.0, 45.0], "atr_multiplier": [1.0, 2.0, 3.0, 4.0]}), "rsi_atr"),
        "mcpt_1000": lambda: mcpt.statistics(mcpt.numpy_scores(bars, "ma_crossover", [{"short": 10.0, "long": 30.0}], 1000)),
        "mcpt_500_reoptimised": lambda: mcpt.statistics(mcpt.numpy_scores(bars, "ma_crossover", [{"short": s, "long": lo} for s in (5.0, 10.0) for lo in (20.0, 30.0, 40.0)], 500)),
        "walk_forward_10": lambda: walkforward.analyse(bars, grid.expand(spark, {"short": [5.0, 8.0, 10.0, 12.0, 15.0], "long": [20.0]}), "ma_crossover", 200, 50),
        "mcpt_sql_8": lambda: plans.mcpt_stats(spark, d),
        "indicator_pack": lambda: base.QUERIES["indicator_pack"](spark, d),
        "ma_frame_all_bars": lambda: strategies.ma_crossover_frame(bars).groupBy("symbol").agg(F.sum("signal")),
    }


def timed(make) -> float:
    """Median seconds of a workload over REPEATS runs, each with its plan made anew."""
    took = []
    for _ in range(REPEATS):
        t = time.perf_counter()
        df: DataFrame = make()
        df.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - t)
    return statistics.median(took)


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    jobs = workloads(spark, d)
    next(iter(jobs.values()))().collect()  # a warm JVM
    queries = {name: round(timed(make), 3) for name, make in jobs.items()}
    print(json.dumps({"metric": "total seconds of headline queries (median of 3)", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
