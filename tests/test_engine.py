"""Operators on small tables with known answers, and edge cases."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import kernels, metrics
from tidemark.functions import windows as X
from tidemark.operators import backtest, bars, folds, permutation, portfolio
from tidemark.operators.strategies import STRATEGIES
from tidemark.plans import grid, mcpt, report, walkforward
from tidemark.schema import cleaned, require
from tidemark.sources import files, klines

T0 = datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp_ntz, bar_idx int, open double, high double, low double, close double, volume double"


def make(spark, closes, symbol="a"):
    rows = [(symbol, T0 + timedelta(hours=i), i, c, None if c is None else c + 1, None if c is None else c - 1, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, SCHEMA)


def walk(n, seed=42, start=30000.0, mean=0.0001, sd=0.02):
    rng = np.random.default_rng(seed)
    return (start * np.cumprod(1 + rng.normal(mean, sd, n))).tolist()


def arrays(closes):
    c = np.array(closes, dtype=float)
    return {"open": c.copy(), "high": c + 1, "low": c - 1, "close": c, "volume": np.ones(len(c))}


# bars


def test_ticks_to_bars_take_first_and_last_in_order(spark):
    ticks = spark.createDataFrame([("a", T0, 2, 5.0), ("a", T0, 1, 7.0), ("a", T0 + timedelta(minutes=5), 3, 6.0)], "s string, ts timestamp_ntz, id int, p double")
    r = bars.from_ticks(ticks, F.col("s"), F.col("ts"), F.col("p"), ["ts", "id"], "hour").first()
    assert (r.open, r.high, r.low, r.close, r.volume) == (7.0, 7.0, 5.0, 6.0, 3.0)
    b = bars.from_ticks(ticks, F.col("s"), F.col("ts"), F.col("p"), ["ts", "id"], "hour")
    assert "SortAggregate" not in b._jdf.queryExecution().executedPlan().toString()


def test_nan_and_text_become_null(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",)], "close string")
    assert [r.close for r in cleaned(df).collect()] == [1.5, None, None]
    with pytest.raises(ValueError):
        require(df)


def test_quality_report_counts_and_drops_nothing(spark):
    rows = [("a", T0, 100.0, 105.0, 98.0, 102.0, 1000.0), ("a", T0, 101.0, 100.0, 100.0, 103.0, -1.0), ("a", T0, None, 103.0, 97.0, 0.0, None)]
    r = bars.quality_report(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")).first()
    assert (r.n_rows, r.invalid_ohlc, r.non_positive, r.negative_volume, r.missing_open, r.missing_volume) == (3, 1, 1, 1, 1, 1)


def test_empty_bars(spark):
    b = make(spark, [])
    assert bars.quality_report(b).count() == 0
    assert backtest.run(b.withColumn("signal", F.lit(1))).count() == 0
    assert folds.indicator_pack(b).count() == 0
    assert walkforward.windows(b, 5, 2).count() == 0


def test_dedup_keeps_the_first_part(spark):
    a, b = make(spark, [1.0, 2.0]), make(spark, [9.0, 9.0, 3.0])
    got = bars.deduplicated([a, b]).orderBy("ts").collect()
    assert [r.close for r in got] == [1.0, 2.0, 3.0]


def test_asof_takes_the_latest_and_can_fill_back(spark):
    b = make(spark, [1.0, 2.0, 3.0])
    level = b.filter("bar_idx = 1").select("symbol", "ts", F.lit(7.0).alias("level"))
    assert [r.asof_level for r in bars.asof(b, level, "level").orderBy("bar_idx").collect()] == [None, 7.0, 7.0]
    assert [r.asof_level for r in bars.asof(b, level, "level", fill_back=True).orderBy("bar_idx").collect()] == [7.0, 7.0, 7.0]


# windows and metrics


def test_rolling_needs_full_frames_and_no_nulls(spark):
    b = make(spark, [1.0, None, 3.0, 5.0])
    got = b.select("bar_idx", X.rolling(F.avg, "close", 2, X.series()).alias("m")).orderBy("bar_idx").collect()
    assert [r.m for r in got] == [None, None, None, 4.0]


def test_backtest_rules(spark):
    b = make(spark, [100.0, 110.0, 99.0, 99.0]).withColumn("signal", F.element_at(F.array(F.lit(1), F.lit(1), F.lit(-1), F.lit(-1)), F.col("bar_idx") + 1))
    got = [r.ret for r in backtest.simulate(b, cost=0.01).orderBy("bar_idx").collect()]
    assert got == pytest.approx([0.0, 0.1, -0.1 - 0.02, 0.0])  # no cost on bar 0, two units on a reversal


def test_flat_signal_counts_one_trade_and_zero_metrics(spark):
    r = backtest.run(make(spark, [5.0] * 6).withColumn("signal", F.lit(0))).first()
    assert (r.total_trades, r.total_return, r.sharpe_ratio, r.profit_factor, r.calmar_ratio, r.max_drawdown) == (1, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_only_gains_have_an_infinite_profit_factor(spark):
    r = backtest.run(make(spark, [1.0, 2.0, 3.0]).withColumn("signal", F.lit(1)), cost=0.0).first()
    assert r.profit_factor == math.inf and r.win_rate == pytest.approx(2 / 3)


def test_zero_price_earns_nothing(spark):
    got = [r.ret for r in backtest.simulate(make(spark, [0.0, 5.0, 10.0]).withColumn("signal", F.lit(1)), cost=0.0).orderBy("bar_idx").collect()]
    assert got == [0.0, 0.0, 1.0]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-0.5, 0.5), min_size=2, max_size=40))
def test_metrics_kernel_bounds(ret):
    r = np.array(ret)
    m = kernels.metrics(r, np.ones(len(r)), 252)
    assert m["max_drawdown"] <= 0 and 0 <= m["win_rate"] <= 1
    assert m["winning_trades"] + m["losing_trades"] <= len(r)


def test_metrics_kernel_agrees_with_columns(spark):
    closes = walk(300)
    b = make(spark, closes)
    s = folds.signals(b, "rsi_atr")
    got = backtest.run(s).first().asDict()
    signal = STRATEGIES["rsi_atr"].signals(arrays(closes))
    want = kernels.metrics(kernels.returns(np.array(closes), signal, 0.0007), signal, 252)
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_objectives():
    with pytest.raises(ValueError):
        metrics.objective("fame")


# recursions on hand-made numbers


def test_ema_rsi_atr_by_hand():
    x = np.array([1.0, 2.0, 3.0, 2.0])
    assert kernels.ema(x, 3)[2:].tolist() == [2.25, 2.125]
    assert np.isnan(kernels.ema(x, 3)[:2]).all()
    r = kernels.rsi(x, 2)
    # gains 0 1 1 0 and losses 0 0 0 1, halved each time
    assert math.isnan(r[0]) and r[1] == 100.0 and r[2] == 100.0 and r[3] == pytest.approx(100 - 100 / (1 + 0.375 / 0.5))
    a = kernels.atr(x + 1, x - 1, x, 2)
    assert a.tolist() == [0.0, 2.0, 2.0, 2.0]


def test_stop_automaton_one_change_per_bar():
    c = np.array([10.0, 10.0, 5.0, 11.0, 20.0])
    up = np.array([False, True, True, True, True])
    got = kernels.stop_automaton(c, up, ~up, np.full(5, 2.0), 1)
    assert got.tolist() == [0, 1, 0, 1, 1]


def test_stop_on_the_other_side():
    c = np.array([10.0, 10.0, 10.0, 13.0])
    up = np.array([True] * 4)
    assert kernels.stop_automaton(c, up, ~up, np.full(4, 2.0), 0, side=-1).tolist() == [1, 0, 1, 1]


@pytest.mark.parametrize("name", sorted(STRATEGIES))
def test_strategies_on_few_bars(name):
    s = STRATEGIES[name]
    for n in (0, 1, 5):
        try:
            assert set(s.signals(arrays([5.0] * n)).tolist()) <= {-1, 0, 1}
        except ValueError:
            assert name in ("donchian", "ma_crossover", "bb_atr")


@pytest.mark.parametrize("name", [n for n, s in STRATEGIES.items() if s.frame])
def test_frames_agree_with_kernels(name, spark):
    closes = walk(200)
    s = STRATEGIES[name]
    got = [r.signal for r in s.frame(make(spark, closes)).orderBy("bar_idx").select("signal").collect()]
    assert got == s.signals(arrays(closes)).tolist()


def test_bad_parameters_raise():
    a = arrays(walk(60))
    for name, p in (("donchian", {"lookback": 1}), ("ma_crossover", {"short": 30, "long": 10}), ("rsi_atr", {"rsi_long": 30, "rsi_short": 40}), ("bb_atr", {"atr_multiplier": 0})):
        with pytest.raises(ValueError):
            STRATEGIES[name].signals(a, p)


# grids


def test_ranges_and_expansion(spark):
    assert grid.value_range(1, 3, 1) == [1, 2, 3] and grid.value_range(1, 3, 1, inclusive=False) == [1, 2]
    assert grid.value_range(0.1, 0.3, 0.1) == [0.1, 0.2, 0.3] and grid.value_range(3, 1, 1) == []
    rows = grid.expand(spark, {"a": [1, 2], "b": [5, 6, 7]}).orderBy("param_id").collect()
    assert [(r.param_id, r.a, r.b) for r in rows] == [(i, float(1 + i // 3), float(5 + i % 3)) for i in range(6)]


def test_invalid_combinations_rank_last_with_an_error(spark):
    b = make(spark, walk(120))
    got = grid.search(b, grid.expand(spark, {"short": [5, 40], "long": [20]}), "ma_crossover").orderBy("rank").collect()
    assert got[0].error is None and got[1].objective == -math.inf and "below long" in got[1].error


def test_ties_rank_by_param_id(spark):
    b = make(spark, [5.0] * 60)
    got = grid.search(b, grid.expand(spark, {"short": [2, 3], "long": [10]}), "ma_crossover").orderBy("rank").collect()
    assert [r.param_id for r in got] == [0, 1]


# walk-forward


def test_windows_and_members(spark):
    b = make(spark, walk(30))
    assert [(r.train_start, r.test_end) for r in walkforward.windows(b, 10, 5).orderBy("window_id").collect()] == [(0, 15), (5, 20), (10, 25), (15, 30)]
    for step in (3, 5, 8):
        spans = walkforward.windows(b, 10, 5, step)
        want = b.join(spans, (b.symbol == spans.symbol) & (b.bar_idx >= spans.train_start) & (b.bar_idx < spans.test_end)).groupBy("window_id").count()
        got = walkforward.members(b, 10, 5, step).groupBy("window_id").count()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert walkforward.windows(b, 25, 5).count() == 1 and walkforward.windows(b, 26, 5).count() == 0
    with pytest.raises(ValueError):
        walkforward.windows(b, 0, 5)


def test_combined_curve_chains_and_skips(spark):
    rows = [("a", 0, 0, 10.0, 100.0), ("a", 0, 1, 11.0, 110.0), ("a", 1, 2, 12.0, 0.0), ("a", 1, 3, 13.0, 5.0), ("a", 2, 4, 20.0, 50.0), ("a", 2, 5, 22.0, 100.0)]
    got = walkforward.combined_curve(spark.createDataFrame(rows, "symbol string, window_id int, bar_idx int, close double, equity double"), 100.0).orderBy("bar_idx").collect()
    assert [r.equity for r in got] == pytest.approx([100, 110, 110, 220]) and [r.buy_hold for r in got] == pytest.approx([100, 110, 200, 220])


# permutations


def test_permutations_keep_what_they_must(spark):
    b = make(spark, walk(50))
    perms = spark.range(3).select(F.col("id").alias("perm_id"))
    p = permutation.permute(b, perms, 10).cache()
    assert p.count() == 150
    joined = p.join(b.select("bar_idx", F.col("close").alias("was")), "bar_idx")
    assert joined.filter("bar_idx < 10 AND close <> was").count() == 0
    assert p.filter("high < greatest(open, close) OR low > least(open, close)").count() == 0
    assert permutation.permute(b, perms, 49).join(b.select("bar_idx", F.col("close").alias("was")), "bar_idx").filter("close <> was").count() == 0
    assert permutation.permute_whole(b, perms).groupBy("perm_id").agg(F.sum("close").alias("s")).select(F.round("s", 3)).distinct().count() == 1
    with pytest.raises(ValueError):
        permutation.permute(b, perms, mode="none")


def test_compounded_permutation_ends_where_the_series_does(spark):
    closes = walk(50)
    moved = permutation.permuted_arrays(arrays(closes), 1, reconstruction="compounded")
    assert moved["close"][-1] == pytest.approx(closes[-1])
    p = permutation.permute(make(spark, closes), spark.range(1).select(F.col("id").alias("perm_id")), reconstruction="compounded")
    assert p.filter("bar_idx = 49").first().close == pytest.approx(closes[-1])


def test_statistics_count_failures_below(spark):
    rows = [("a", float("-inf"), 1.0), ("a", 2.0, 1.0), ("a", 1.0, 1.0), ("a", 0.5, 1.0)]
    r = mcpt.statistics(spark.createDataFrame(rows, "symbol string, score double, original_score double")).first()
    assert r.p_value == 0.5 and r.percentile == 50.0 and r.p_value_corrected == pytest.approx(3 / 4)


# portfolio


def _account(close, **over):
    n = len(close)
    rows = {"close": np.array(close, float), "atr": np.full(n, 2.0), **{k: np.full(n, v) for k, v in {"sma_5": 100.0, "sma_10": 100.0, "sma_20": 100.0, "rsi": 50.0, "macd": 0.0, "macd_signal": 0.0, "buy": 0.0, "sell": 0.0}.items()}}
    return portfolio.simulate(rows, portfolio.Rules(fee=0.0, slippage=0.0, risk=1.0, volatility_factor=10.0, most=0.5, confidence=0.9, **over))


def test_portfolio_long_takes_profit():
    value, trades = _account([101.0, 102.0, 108.0])
    q = 50_000 / 101.0
    assert trades.tolist() == [1, 1, 1] and value[-1] == pytest.approx(100_000 + q * 7)


def test_portfolio_short_marks():
    q = 50_000 / 99.0
    value, trades = _account([99.0, 99.0])
    assert trades.tolist() == [1, 1] and value[0] == pytest.approx(100_000 + q * 99 + q * 99)
    value, _ = _account([99.0, 99.0], short_mark="net")
    assert value[0] == pytest.approx(100_000)


def test_portfolio_skips_bad_bars():
    value, trades = _account([0.0, 0.0])
    assert trades.tolist() == [0, 0] and value.tolist() == [100_000.0] * 2


# sources and reports


def test_klines(spark):
    day = klines.DAY_MS
    assert klines.chunks(0, 3 * day, 2) == [(0, 2 * day), (2 * day, 3 * day)]
    with pytest.raises(ValueError):
        klines.chunks(5, 5, 1)
    assert klines.to_millis("1970-01-02") == day
    assert klines.candle({"t": "5", "o": "1", "h": "2", "l": "0.5", "c": "1.5", "vol": "9"}) == (5, 1.0, 2.0, 0.5, 1.5, 9.0)
    assert klines.candle(["x"]) is None
    with pytest.raises(ValueError):
        klines.rows_of({"retCode": 10, "retMsg": "no"})
    calls = []

    def slow(*a):
        calls.append(a)
        if len(calls) < 3:
            raise TimeoutError
        return klines.offline(*a)

    assert len(list(klines.pages(slow, "X", "1h", 0, 10 * 3_600_000, 4))) == 11
    df = klines.read(spark, symbol="X", interval="1d", start="2010-01-01", end="2018-01-01", fetch="tidemark.sources.klines:offline")
    assert df.count() == df.select("ts").distinct().count() == 2923


def test_files(spark, tmp_path):
    with pytest.raises(ValueError):
        files.check_timeframe("5m")
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path), "A", "1h")
    for i, price in enumerate((1, 2)):
        p = tmp_path / f"A_1h_{i}.csv"
        p.write_text(f"timestamp,open,high,low,close,volume\n2024-01-01T00:00:00+0000,{price},2,1,1,1\nbad,1,1,1,1,1\n")
        import os

        os.utime(p, (1000 + i, 1000 + i))
    got = files.load(spark, str(tmp_path), "A", "1h", "2024-01-01", "2024-01-02").collect()
    assert [r.open for r in got] == [2.0]
    assert files.load_local(spark, str(tmp_path), "A", "1h", "2025-01-01", "2025-01-02") is None
    files.save_bars(make(spark, [1.0, 2.0]).drop("bar_idx"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    files.save_run(str(tmp_path / "run"), summary=spark.range(1), curve=make(spark, [1.0]).withColumn("nested", F.array("close")))
    assert "nested" not in spark.read.option("header", True).csv(str(tmp_path / "run/curve")).columns


def test_reports(spark):
    b = make(spark, walk(60)).withColumn("signal", F.when(F.col("bar_idx") % 20 < 10, 1).otherwise(-1))
    got = report.backtest_curves(b).filter("marker IS NOT NULL").orderBy("bar_idx").collect()
    assert [r.marker for r in got] == ["long", "short"] * 3
    js = report.summary_json(spark.createDataFrame([("a", math.inf, 1)], "symbol string, x double, n int")).first().summary
    assert js == '{"x":null,"n":1}'


def test_text_and_settings(tmp_path):
    from tidemark import config

    assert report.text("Run", {"pf": math.inf, "n": 3, "x": 0.5}) == "Run\n---\npf  infinite\nn   3\nx   0.5000"
    path = str(tmp_path / "c.json")
    assert config.load(path)["capital"] == 100_000.0
    config.save(path, {"capital": 5.0})
    assert config.load(path)["capital"] == 5.0
    with pytest.raises(ValueError):
        config.save(path, {"colour": 1})


def test_grid_of_a_strategy(spark):
    assert grid.of_strategy(spark, "donchian").count() == 10 and grid.of_strategy(spark, "macd_atr").count() == 1
    assert STRATEGIES["donchian"].info()["has_frame"]


def test_numpy_permutation_test(spark):
    b = make(spark, walk(120))
    s = mcpt.numpy_scores(b, "ma_crossover", [{"short": 3, "long": 8}, {"short": 9, "long": 2}], 20)
    r = mcpt.statistics(s).first()
    assert r.n_permutations == 20 and 0 <= r.p_value <= 1 and s.filter("score IS NULL").count() == 0
    bad = mcpt.numpy_scores(b, "ma_crossover", [{"short": 9, "long": 2}], 3)
    assert {x.score for x in bad.collect()} == {-math.inf}


def test_klines_over_http(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    class Page(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            body = json.dumps(klines.offline(q["symbol"], {"60": "1h", "D": "1d"}[q["interval"]], int(q["start"]), int(q["end"]), int(q["limit"]))).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        asked = {"symbol": "X", "interval": "1d", "start": "2020-01-01", "end": "2020-03-01", "limit": 7}
        got = klines.read(spark, endpoint=f"http://127.0.0.1:{server.server_port}/kline", **asked)
        want = klines.read(spark, fetch="tidemark.sources.klines:offline", **asked)
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 61
    finally:
        server.shutdown()


def test_payload_shapes(spark):
    pages = ['[["1","2","3","1","2","9"]]', '{"data": [{"t": 1, "o": 2, "h": 3, "l": 1, "c": 2}]}', '{"result": {"data": [["x"]]}}', '{"list": [["1","2","3","1","2","9"], {"start": "2", "o": "2"}]}']
    got = spark.createDataFrame([(p,) for p in pages], "p string").select(klines.decode(F.col("p")).alias("c")).collect()
    assert [[tuple(x) for x in r.c] for r in got] == [[(1, 2.0, 3.0, 1.0, 2.0, 9.0)], [(1, 2.0, 3.0, 1.0, 2.0, 0.0)], [], [(1, 2.0, 3.0, 1.0, 2.0, 9.0)]]
    assert klines.candle({"t": 1, "o": 2, "h": 3, "l": 1, "c": 2}) == (1, 2.0, 3.0, 1.0, 2.0, 0.0)
    with pytest.raises(Exception, match="the exchange says no"):
        spark.createDataFrame([('{"retCode": 10, "retMsg": "no"}',)], "p string").select(klines.decode(F.col("p"))).collect()


def test_files_of_runs(spark, sf_dir, tmp_path):
    import sqlite3

    from tidemark.operators import backtest, strategies
    from tidemark.plans import grid, mcpt, report, walkforward
    from tidemark.queries.base import hourly

    bars = hourly(spark, sf_dir).filter("symbol = 'click'").cache()
    signals, params = strategies.ma_crossover_frame(bars, 10, 30), grid.expand(spark, {"short": [5, 10], "long": [20, 30]})
    found, scores = grid.search(bars, params, "ma_crossover"), mcpt.numpy_scores(bars, "ma_crossover", [{"short": 5.0, "long": 20.0}], 20)
    walked = walkforward.analyse(bars, params, "ma_crossover", 100, 40)
    path = str(tmp_path / "run")
    files.save_backtest(path, backtest.run(signals), backtest.simulate(signals))
    files.save_optimisation(path, found)
    files.save_permutations(path, mcpt.statistics(scores), scores)
    files.save_walkforward(path, walkforward.summary(walked), walked, walkforward.windows(bars, 100, 40), params)
    rows = lambda name: spark.read.option("header", True).csv(f"{path}/{name}").count()
    assert rows("backtest_data") == rows("returns") == rows("equity_curve") == bars.count()
    assert rows("optimization/optimization_results") == 4 and rows("mcpt/permutation_scores") == 20 and rows("walkforward/window_params") == walked.count()
    finite = scores.filter("abs(score) < double('inf')")
    assert report.save_all(f"{path}/tables", signals, found, ("short",), finite) == ["backtest", "optimization_short", "optimization_final", "mcpt"]
    for bad in ("NaN", "Infinity"):
        with pytest.raises(ValueError, match="finite"):
            report.checked_scores(scores.withColumn("score", F.lit(bad).cast("double")))
    with pytest.raises(ValueError, match="p-values"):
        report.checked_scores(finite.withColumn("p", F.lit(1.5)), "p")
    db = sqlite3.connect(tmp_path / "bars.db")
    db.execute("CREATE TABLE sol (timestamp TEXT, open REAL, high REAL, low REAL, close REAL, volume REAL)")
    db.executemany("INSERT INTO sol VALUES (?, 1, 2, 0.5, 1.5, 3)", [(f"2024-01-{d:02d} 00:00:00",) for d in range(1, 31)])
    db.commit()
    db.close()
    assert files.scan_sqlite(spark, str(tmp_path / "bars.db"), "sol", "SOL", 4).agg(F.count("*"), F.sum("close")).first()[:] == (30, 45.0)
    assert grid.successive_halving(bars, params, "ma_crossover", keep=0.5).count() == 1 and [x[0] for x in grid.speed_up(bars, params, "ma_crossover", (1, 2))] == [1, 2]
    n = bars.count()
    cut = walkforward.windows(bars, 100, 40, offset=10, least_test=5).collect()
    assert min(r.train_start for r in cut) == 10 and max(r.test_end for r in cut) == n and all(r.test_end - r.test_start >= 5 for r in cut)
