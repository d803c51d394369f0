"""Queries: grids, walk-forward, permutation tests and their statistics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import stats
from ..functions import windows as X
from ..operators import backtest, permutation, strategies
from ..plans import grid, mcpt, report, walkforward
from .base import COUNTS, H, METRIC_SQL, W, hourly, ma_signals, metric_columns, metric_tables, query, r, rounded, simulated

GRID = {"short": [5, 10, 15], "long": [10, 20, 30]}
TRAIN, TEST = 200, 50
N_PERM = 8  # of the queries that DuckDB checks
N_FULL, N_REOPTIMISED, N_WALK_FORWARD = 1000, 500, 200  # of the tests proper
_PARAMS = "params AS (SELECT CAST((s - 1) * 3 + (l - 1) AS INT) AS param_id, s * 5.0::DOUBLE AS short, l * 10.0::DOUBLE AS long FROM range(1, 4) a(s), range(1, 4) b(l))"
_VALID = [(i, s, lo) for i, (s, lo) in enumerate((s, lo) for s in GRID["short"] for lo in GRID["long"]) if s < lo]


def _grid(spark: SparkSession) -> DataFrame:
    return grid.expand(spark, GRID)


@query(f"WITH {_PARAMS} SELECT * FROM params")
def grid_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark)


@query(f"WITH {_PARAMS} SELECT *, CASE WHEN short < 1 THEN 'short must be 1 or more' WHEN NOT short < long THEN 'short must be below long' END AS error FROM params")
def grid_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.checked(_grid(spark), "ma_crossover")


@query("SELECT unnest([10.0::DOUBLE, 12.5, 15.0, 17.5, 20.0]) AS value, true AS inclusive UNION ALL SELECT unnest([10.0::DOUBLE, 12.5, 15.0, 17.5]), false")
def range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A (first, last, step) range with and without its end."""
    rows = [(v, True) for v in grid.value_range(10, 20, 2.5)] + [(v, False) for v in grid.value_range(10, 20, 2.5, inclusive=False)]
    return spark.createDataFrame(rows, "value double, inclusive boolean")


def _runs(source: str, keys: tuple[str, ...]) -> str:
    """SQL: the runs of all valid combinations over source (keys, bar_idx, close), as table met with param_id."""
    parts = ", ".join(ma_signals(source, str(s), str(lo), keys, f"g{i}") for i, s, lo in _VALID)
    every = " UNION ALL ".join(f"SELECT {', '.join(keys)}, bar_idx, close, signal, {i} AS param_id FROM g{i}" for i, _, _ in _VALID)
    own = (*keys, "param_id")
    return f"{parts}, sig AS ({every}), {simulated('sig', own)}, {metric_tables(own)}"


_GRID_SQL = f"""{_PARAMS}, {_runs('bars', ('symbol',))},
res AS (SELECT symbol, param_id, {', '.join(f'{METRIC_SQL[m].format(p=252)} AS {m}' for m in METRIC_SQL)} FROM met GROUP BY symbol, param_id),
every AS (SELECT s.symbol, p.param_id, p.short, p.long, r.* EXCLUDE (symbol, param_id), CASE WHEN r.symbol IS NULL THEN '-Infinity'::DOUBLE ELSE r.sharpe_ratio END AS objective FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN params p LEFT JOIN res r ON r.symbol = s.symbol AND r.param_id = p.param_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY objective DESC NULLS LAST, param_id) AS INT) AS rank FROM every)"""


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.search(hourly(spark, sf_dir), _grid(spark), "ma_crossover")


@query(f"WITH {H}, {_GRID_SQL} SELECT symbol, param_id, short, long, {', '.join(r(c) for c in ('total_return', 'sharpe_ratio', 'max_drawdown', 'profit_factor', 'objective'))}, rank FROM ranked")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of a crossover's two means; invalid ones rank last."""
    return rounded(_search(spark, sf_dir).select("symbol", "param_id", "short", "long", "total_return", "sharpe_ratio", "max_drawdown", "profit_factor", "objective", "rank"))


@query(f"WITH {H}, {_GRID_SQL} SELECT symbol, param_id, short, long, {r('objective')} FROM ranked WHERE rank = 1")
def best_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.best(_search(spark, sf_dir)).select("symbol", "param_id", "short", "long", "objective"))


@query(f"WITH {H}, {_GRID_SQL} SELECT short, {r('avg(objective)', 'mean', 5)}, {r('stddev_samp(objective)', 'std', 5)}, {r('min(objective)', 'min', 5)}, {r('max(objective)', 'max', 5)}, count(objective) AS n FROM ranked WHERE sharpe_ratio IS NOT NULL GROUP BY short")
def param_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.sensitivity(_search(spark, sf_dir), "short"), 5)


@query(f"WITH {H}, {_GRID_SQL}, p AS (SELECT long, max(objective) AS largest, avg(objective) AS mean, min(objective) AS least FROM ranked WHERE sharpe_ratio IS NOT NULL GROUP BY long) SELECT long, {r('largest', digits=5)}, {r('mean', digits=5)}, {r('least', digits=5)}, largest = max(largest) OVER () AS is_best FROM p")
def param_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.profile(_search(spark, sf_dir), "long"), 5)


@query(f"WITH {H}, {_GRID_SQL} SELECT long, {', '.join(r(f'avg(objective) FILTER (short = {s})', f'short_{s}', 5) for s in GRID['short'])} FROM ranked WHERE sharpe_ratio IS NOT NULL GROUP BY long")
def param_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.heat_map(_search(spark, sf_dir), "long", "short", [float(s) for s in GRID["short"]]), 5)


@query(f"WITH {H}, {_GRID_SQL} SELECT short, {r('avg(objective) - stddev_samp(objective)', 'low', 5)}, {r('avg(objective) + stddev_samp(objective)', 'high', 5)} FROM ranked WHERE sharpe_ratio IS NOT NULL GROUP BY short")
def param_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = grid.sensitivity(_search(spark, sf_dir), "short")
    return rounded(s.select("short", (F.col("mean") - F.col("std")).alias("low"), (F.col("mean") + F.col("std")).alias("high")), 5)


@query(f"WITH {H}, {_GRID_SQL}, o AS (SELECT symbol, param_id, sharpe_ratio * win_rate + profit_factor AS objective FROM ranked WHERE sharpe_ratio IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY objective DESC, param_id) AS rank FROM o) SELECT symbol, param_id, {r('objective')} FROM k WHERE rank = 1")
def custom_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best combination by an expression over the metrics."""
    by = F.col("sharpe_ratio") * F.col("win_rate") + F.col("profit_factor")
    return rounded(grid.best(grid.search(hourly(spark, sf_dir), _grid(spark), "ma_crossover", by)).select("symbol", "param_id", "objective"))


@query(f"WITH {H}, {_GRID_SQL} SELECT symbol, param_id, {r('100000 * (1 + total_return)', 'final_value', 3)} FROM ranked WHERE sharpe_ratio IS NOT NULL")
def grid_final_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the capital became under each combination."""
    done = grid.final_values(_search(spark, sf_dir).filter("error IS NULL"))
    return rounded(done.select("symbol", "param_id", "final_value"), 3)


@query(f"WITH {H}, {_GRID_SQL} SELECT symbol, short, long, {r('objective')} FROM ranked WHERE rank = 1 AND sharpe_ratio IS NOT NULL")
def quick_optimise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.quick_optimise(hourly(spark, sf_dir), "ma_crossover", GRID))


@query(f"WITH {H}, {_GRID_SQL}, t AS (SELECT symbol, param_id, short, long, objective FROM ranked ORDER BY objective DESC NULLS LAST, symbol, param_id LIMIT 8) SELECT symbol, param_id, {r('objective')}, {r('CASE WHEN max(short) OVER () > min(short) OVER () THEN (short - min(short) OVER ()) / (max(short) OVER () - min(short) OVER ()) ELSE short END', 'short_scaled')}, {r('CASE WHEN max(long) OVER () > min(long) OVER () THEN (long - min(long) OVER ()) / (max(long) OVER () - min(long) OVER ()) ELSE long END', 'long_scaled')} FROM t")
def top_n_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best runs of all, with scaled parameters (a top-k report)."""
    return rounded(grid.top(_search(spark, sf_dir), 8, ["short", "long"]).select("symbol", "param_id", "objective", "short_scaled", "long_scaled"))


@query(f"WITH {_PARAMS} SELECT * FROM params ORDER BY md5('3:' || param_id), param_id LIMIT 4")
def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four combinations drawn by a seed (a sampling operator)."""
    return grid.random_search(_grid(spark), 4, 3)


@query(f"WITH {H}, {_runs('bars', ('symbol',))}, res AS (SELECT symbol, param_id, {METRIC_SQL['max_drawdown']} AS max_drawdown FROM met GROUP BY symbol, param_id) SELECT symbol, arg_min(param_id, (max_drawdown, param_id)) AS parity_param, arg_max(param_id, (max_drawdown, -param_id)) AS best_param FROM res GROUP BY symbol")
def drawdown_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combination that the drawdown objective picks in either sense."""
    b, p = hourly(spark, sf_dir), grid.expand(spark, GRID)
    pick = lambda sense, name: grid.best(grid.search(b, p, "ma_crossover", "max_drawdown", drawdown_sense=sense)).select("symbol", F.col("param_id").alias(name))
    return pick("parity", "parity_param").join(pick("best", "best_param"), "symbol")


_WIN = f"cnt AS (SELECT symbol, CAST(count(*) AS INT) AS n FROM bars GROUP BY symbol), win AS (SELECT symbol, CAST(k AS INT) AS window_id, CAST(k * {TEST} AS INT) AS train_start, CAST(k * {TEST} + {TRAIN} AS INT) AS train_end, CAST(k * {TEST} + {TRAIN} AS INT) AS test_start, CAST(k * {TEST} + {TRAIN + TEST} AS INT) AS test_end FROM cnt, LATERAL (SELECT unnest(range(0, (n - {TRAIN + TEST}) // {TEST} + 1)) AS k) WHERE n >= {TRAIN + TEST})"


@query(f"WITH {H}, {_WIN} SELECT * FROM win")
def wf_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walkforward.windows(hourly(spark, sf_dir), TRAIN, TEST)


@query(f"WITH {H}, {_WIN} SELECT b.symbol, b.bar_idx, w.window_id, CASE WHEN b.bar_idx < w.train_end THEN 'train' ELSE 'test' END AS part FROM bars b JOIN win w ON b.symbol = w.symbol AND b.bar_idx >= w.train_start AND b.bar_idx < w.test_end")
def wf_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of each window, by arithmetic in place of a range join."""
    return walkforward.members(hourly(spark, sf_dir), TRAIN, TEST).select("symbol", "bar_idx", "window_id", "part")


_K = ("symbol", "window_id", "part")
_WF = f"""{_WIN},
mem AS (SELECT b.symbol, w.window_id, CASE WHEN b.bar_idx < w.train_end THEN 'train' ELSE 'test' END AS part, b.bar_idx AS full_idx, CAST(b.bar_idx - CASE WHEN b.bar_idx < w.train_end THEN w.train_start ELSE w.test_start END AS INT) AS bar_idx, b.close FROM bars b JOIN win w ON b.symbol = w.symbol AND b.bar_idx >= w.train_start AND b.bar_idx < w.test_end),
{_runs('mem', _K)},
res AS (SELECT symbol, window_id, part, param_id, {', '.join(f'{METRIC_SQL[m].format(p=252)} AS {m}' for m in METRIC_SQL)} FROM met GROUP BY symbol, window_id, part, param_id),
trained AS (SELECT *, row_number() OVER (PARTITION BY symbol, window_id ORDER BY sharpe_ratio DESC NULLS LAST, param_id) AS rank FROM res WHERE part = 'train'),
best AS (SELECT i.symbol, i.window_id, i.param_id, {', '.join(f'i.{m} AS is_{m}, o.{m} AS oos_{m}' for m in METRIC_SQL)} FROM trained i JOIN res o ON o.part = 'test' AND o.symbol = i.symbol AND o.window_id = i.window_id AND o.param_id = i.param_id WHERE i.rank = 1)"""
_WF_COLUMNS = [f"{p}_{m}" for p in ("is", "oos") for m in ("total_return", "sharpe_ratio", "max_drawdown", "profit_factor", "win_rate", "total_trades")]


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # combinations whose means need more bars than a test window would fail there, as they must
    return walkforward.analyse(hourly(spark, sf_dir), _grid(spark), "ma_crossover", TRAIN, TEST)


@query(f"WITH {H}, {_WF} SELECT symbol, window_id, param_id, {', '.join(r(c, digits=5) for c in _WF_COLUMNS)} FROM best")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best combination on each train window, and its metrics there and on the test window."""
    return rounded(_analysed(spark, sf_dir).select("symbol", "window_id", "param_id", *_WF_COLUMNS), 5)


@query(f"""WITH {H}, {_WF} SELECT symbol, count(*) AS n_windows, {r('avg(oos_sharpe_ratio)', 'mean_sharpe', 4)}, {r('stddev_samp(oos_sharpe_ratio)', 'std_sharpe', 4)}, {r('avg(oos_total_return)', 'mean_return', 5)}, {r('avg(oos_max_drawdown)', 'mean_drawdown', 5)},
{r('avg(oos_profit_factor)', 'mean_profit_factor', 5)}, {r('avg(oos_win_rate)', 'mean_win_rate', 5)}, {r('CAST(sum(oos_total_trades) AS DOUBLE)', 'total_trades')}, count(*) FILTER (oos_total_return > 0) AS positive_windows, count(*) FILTER (oos_total_return <= 0) AS negative_windows,
{r('count(*) FILTER (oos_total_return > 0) / count(*)', 'consistency', 5)}, {r('coalesce(avg(oos_sharpe_ratio) / nullif(avg(is_sharpe_ratio), 0), 0)', 'oos_is_ratio', 4)} FROM best GROUP BY symbol""")
def wf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(walkforward.summary(_analysed(spark, sf_dir)), 5, mean_sharpe=4, std_sharpe=4, oos_is_ratio=4)


@query(f"WITH {H}, {_WF} SELECT symbol, {r('avg(oos_sharpe_ratio)', 'mean_sharpe', 4)}, {r('sum(oos_total_return)', 'sum_return', 5)}, {r('min(oos_max_drawdown)', 'max_drawdown', 5)}, {r('CAST(sum(oos_total_trades) AS DOUBLE)', 'total_trades')} FROM best GROUP BY symbol")
def wf_compact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(walkforward.compact_summary(_analysed(spark, sf_dir)), 5, mean_sharpe=4)


_CURVES = f"""{_WIN},
mem AS (SELECT b.symbol, w.window_id, b.bar_idx AS full_idx, CAST(b.bar_idx - w.test_start AS INT) AS bar_idx, b.close FROM bars b JOIN win w ON b.symbol = w.symbol AND b.bar_idx >= w.test_start AND b.bar_idx < w.test_end),
{ma_signals('mem', '5', '10', ('symbol', 'window_id'))}, {simulated('sig', ('symbol', 'window_id'))},
eq AS (SELECT *, 10000 * product(1 + ret) OVER (PARTITION BY symbol, window_id ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM sim),
gr AS (SELECT symbol, window_id, arg_max(equity, bar_idx) / arg_min(equity, bar_idx) AS g, arg_min(equity, bar_idx) AS f FROM eq GROUP BY 1, 2),
ah AS (SELECT *, coalesce(product(g) OVER (PARTITION BY symbol ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS ahead FROM gr),
cc AS (SELECT e.symbol, e.window_id, e.full_idx AS bar_idx, 10000 * a.ahead * e.equity / a.f AS equity, 10000 * e.close / first_value(e.close) OVER (PARTITION BY e.symbol ORDER BY e.full_idx) AS buy_hold FROM eq e JOIN ah a ON a.symbol = e.symbol AND a.window_id = e.window_id)"""


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = walkforward.members(hourly(spark, sf_dir), TRAIN, TEST).filter("part = 'test'")
    keys = ("symbol", "window_id")
    own = m.withColumn("full_idx", F.col("bar_idx")).withColumn("bar_idx", F.row_number().over(X.series(keys)) - 1)
    done = backtest.simulate(strategies.ma_crossover_frame(own, 5, 10, keys), keys, capital=10_000.0)
    return walkforward.combined_curve(done.select("symbol", "window_id", F.col("full_idx").alias("bar_idx"), "close", "equity"))


@query(f"WITH {H}, {_CURVES} SELECT symbol, window_id, bar_idx, {r('equity', digits=4)}, {r('buy_hold', digits=4)} FROM cc")
def wf_combined_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_combined(spark, sf_dir), 4)


@query(f"WITH {H}, {_CURVES}, t AS (SELECT *, max(equity) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM cc) SELECT symbol, window_id, bar_idx, {r('equity', digits=4)}, {r('buy_hold', digits=4)}, {r('(equity - top) / top', 'drawdown')} FROM t")
def report_walkforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.walkforward_curves(_combined(spark, sf_dir)), 4, drawdown=6)


def _perms(spark: SparkSession, n: int = N_PERM) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("perm_id"))


def _permuted(compounded: bool = False, n: int = N_PERM, start: int = 0) -> str:
    """SQL: the table perm of permuted bars."""
    own = "symbol, perm_id"
    more = f" + coalesce(sum(c) OVER (PARTITION BY {own} ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)" if compounded else ""
    return f"""
dec_ AS (SELECT *, lag(close) OVER ({W}) AS anchor, ln(open) - ln(coalesce(lag(close) OVER ({W}), open)) AS r_o, ln(high) - ln(open) AS r_h, ln(low) - ln(open) AS r_l, ln(close) - ln(open) AS r_c FROM bars),
ev AS (SELECT d.*, p.perm_id FROM dec_ d, (SELECT unnest(range({n})) AS perm_id) p WHERE bar_idx >= {start}),
gp AS (SELECT {own}, row_number() OVER (PARTITION BY {own} ORDER BY md5(perm_id || ':gap:' || bar_idx), bar_idx) - 1 + {start} AS bar_idx, r_o AS g FROM ev),
inr AS (SELECT {own}, row_number() OVER (PARTITION BY {own} ORDER BY md5(perm_id || ':intraday:' || bar_idx), bar_idx) - 1 + {start} AS bar_idx, r_h AS h, r_l AS l, r_c AS c FROM ev),
lo_0 AS (SELECT e.symbol, e.perm_id, e.bar_idx, e.volume, g, h, l, c, first_value(ln(coalesce(e.anchor, e.open))) OVER (PARTITION BY e.symbol, e.perm_id ORDER BY e.bar_idx) AS base FROM ev e JOIN gp USING (symbol, perm_id, bar_idx) JOIN inr USING (symbol, perm_id, bar_idx)),
lo_1 AS (SELECT *, base + sum(g) OVER (PARTITION BY {own} ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW){more} AS lo FROM lo_0),
perm AS (SELECT {own}, bar_idx, exp(lo) AS open, greatest(exp(lo + h), exp(lo), exp(lo + c)) AS high, least(exp(lo + l), exp(lo), exp(lo + c)) AS low, exp(lo + c) AS close, volume FROM lo_1)"""


@query(f"WITH {H}, {_permuted()} SELECT symbol, perm_id, bar_idx, {r('open')}, {r('high')}, {r('low')}, {r('close')}, volume FROM perm")
def bar_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(permutation.permute(hourly(spark, sf_dir), _perms(spark)).drop("ts"))


@query(f"WITH {H}, {_permuted(True, 4, 100)}, every AS (SELECT symbol, perm_id, bar_idx, open, high, low, close, volume FROM perm UNION ALL SELECT symbol, perm_id, bar_idx, open, high, low, close, volume FROM bars, (SELECT unnest(range(4)) AS perm_id) WHERE bar_idx < 100) SELECT symbol, perm_id, bar_idx, {r('open', digits=5)}, {r('high', digits=5)}, {r('low', digits=5)}, {r('close', digits=5)}, volume FROM every")
def bar_permutation_compounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutations from bar 100 on that carry the moves within bars along."""
    few = _perms(spark).filter("perm_id < 4")
    return rounded(permutation.permute(hourly(spark, sf_dir), few, 100, reconstruction="compounded").drop("ts"), 5)


@query(f"WITH {H}, ev AS (SELECT b.*, perm_id FROM bars b, (SELECT unnest(range({N_PERM})) AS perm_id)) SELECT symbol, perm_id, row_number() OVER (PARTITION BY symbol, perm_id ORDER BY md5(perm_id || ':bar:' || bar_idx), bar_idx) - 1 AS bar_idx, open, high, low, close, volume FROM ev")
def bar_permutation_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.permute_whole(hourly(spark, sf_dir), _perms(spark)).drop("ts").withColumn("bar_idx", F.col("bar_idx").cast("long"))


def _score_sql(source: str, short: str, long: str, keys: tuple[str, ...], tag: str) -> str:
    """SQL: symbol (and perm_id) and the profit factor of a crossover over source, as the table tag."""
    own = {"sig": f"{tag}_g", "sim": f"{tag}_s"}
    sim = simulated(own["sig"], keys).replace("sim_0", f"{tag}_s0").replace("sim AS", f"{own['sim']} AS")
    return f"{ma_signals(source, short, long, keys, own['sig'])}, {sim}, {tag} AS (SELECT {', '.join(keys)}, {METRIC_SQL['profit_factor']} AS score FROM {own['sim']} GROUP BY {', '.join(keys)})"


_MCPT = f"{_permuted()}, {_score_sql('bars', '10', '30', ('symbol',), 'orig')}, {_score_sql('perm', '10', '30', ('symbol', 'perm_id'), 'tried')}, scored AS (SELECT t.symbol, t.perm_id, t.score, o.score AS original_score FROM tried t JOIN orig o USING (symbol))"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcpt.scores(hourly(spark, sf_dir), partial(strategies.ma_crossover_frame, short=10, long=30), _perms(spark))


@query(f"WITH {H}, {_MCPT} SELECT symbol, perm_id, {r('score', digits=5)}, {r('original_score', digits=5)} FROM scored")
def mcpt_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of fixed parameters on permuted bars."""
    return rounded(_scores(spark, sf_dir), 5)


_STATS = f"""SELECT symbol, {r('max(original_score)', 'original_score', 5)}, count(score) AS n_permutations, {r('avg((score >= original_score)::INT)', 'p_value')}, {r("(count(*) FILTER (score > '-Infinity'::DOUBLE AND score >= original_score) + 1) / (count(*) FILTER (score > '-Infinity'::DOUBLE) + 1)", 'p_value_corrected')},
{r('avg((score < original_score)::INT) * 100', 'percentile')}, avg((score >= original_score)::INT) < 0.05 AS significant, {r('avg(score)', 'mean_score', 5)}, {r('stddev_pop(score)', 'std_score', 5)}, {r('min(score)', 'min_score', 5)}, {r('max(score)', 'max_score', 5)}, {r('median(score)', 'median_score', 5)} FROM scored GROUP BY symbol"""


@query(f"WITH {H}, {_MCPT} {_STATS}")
def mcpt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mcpt.statistics(_scores(spark, sf_dir)), 5, p_value=6, p_value_corrected=6, percentile=6)


@query(f"WITH {H}, {_MCPT} SELECT symbol, {r('(count(*) FILTER (score >= original_score) + 1) / (count(*) + 1)', 'p_value')} FROM scored GROUP BY symbol")
def mcpt_pvalue_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mcpt.statistics(_scores(spark, sf_dir))
    return rounded(s.select("symbol", F.col("p_value_corrected").alias("p_value")))


_RE = f"{_permuted()}, {_score_sql('bars', '5', '20', ('symbol',), 'oa')}, {_score_sql('bars', '10', '30', ('symbol',), 'ob')}, {_score_sql('perm', '5', '20', ('symbol', 'perm_id'), 'ta')}, {_score_sql('perm', '10', '30', ('symbol', 'perm_id'), 'tb')}"


@query(f"WITH {H}, {_RE} SELECT ta.symbol, ta.perm_id, {r('greatest(ta.score, tb.score)', 'score', 5)}, {r('greatest(oa.score, ob.score)', 'original_score', 5)} FROM ta JOIN tb USING (symbol, perm_id) JOIN oa USING (symbol) JOIN ob USING (symbol)")
def mcpt_reoptimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the best of two combinations on each permutation."""
    frames = [partial(strategies.ma_crossover_frame, short=s, long=lo) for s, lo in ((5, 20), (10, 30))]
    return rounded(mcpt.reoptimised(hourly(spark, sf_dir), frames, _perms(spark)), 5)


def _full_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcpt.numpy_scores(hourly(spark, sf_dir), "ma_crossover", [{"short": 10.0, "long": 30.0}], N_FULL)


@query()
def mcpt_normal_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mcpt_normal with 1000 permutations, by numpy's generator."""
    return rounded(_full_scores(spark, sf_dir).select("symbol", "perm_id", "score", "original_score"), 5)


@query()
def mcpt_pvalue_corrected_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mcpt.statistics(_full_scores(spark, sf_dir))
    return rounded(s.select("symbol", F.col("p_value_corrected").alias("p_value")))


@query()
def report_distribution_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.score_distribution(_full_scores(spark, sf_dir), 5))


@query()
def mcpt_reoptimized_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the best of all valid combinations of the grid on each of 500 permutations, by numpy's generator."""
    params = [{"short": float(s), "long": float(lo)} for _, s, lo in _VALID]
    s = mcpt.numpy_scores(hourly(spark, sf_dir), "ma_crossover", params, N_REOPTIMISED)
    return rounded(s.select("symbol", "perm_id", "score", "original_score"), 5)


@query()
def signal_shuffle_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_shuffle with 1000 permutations."""
    s = strategies.ma_crossover_frame(hourly(spark, sf_dir), 10, 30)
    return rounded(mcpt.signal_scores(s, _perms(spark, N_FULL)).select("symbol", "perm_id", "score"), 5)


@query()
def walk_forward_mcpt_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """walk_forward_mcpt with 200 permutations."""
    s = mcpt.walk_forward_scores(hourly(spark, sf_dir), _grid(spark), "ma_crossover", _perms(spark, N_WALK_FORWARD), TRAIN, TEST)
    return rounded(s.select("symbol", "perm_id", "score", "original_score"), 5)


@query()
def mcpt_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 permutations by numpy's generator, with fixed parameters, and their statistics."""
    s = mcpt.numpy_scores(hourly(spark, sf_dir), "ma_crossover", [{"short": 10.0, "long": 30.0}], 1000)
    return rounded(mcpt.statistics(s))


_SHUF = f"{ma_signals('bars', '10', '30')}, ev AS (SELECT symbol, bar_idx, close, signal, perm_id FROM sig, (SELECT unnest(range({N_PERM})) AS perm_id)), sh AS (SELECT symbol, perm_id, signal, row_number() OVER (PARTITION BY symbol, perm_id ORDER BY md5(perm_id || ':signal:' || bar_idx), bar_idx) - 1 AS bar_idx FROM ev), moved AS (SELECT e.symbol, e.perm_id, e.bar_idx, e.close, s.signal FROM ev e JOIN sh s USING (symbol, perm_id, bar_idx)), {simulated('moved', ('symbol', 'perm_id'))}"


@query(f"WITH {H}, {_SHUF} SELECT symbol, perm_id, {r(METRIC_SQL['profit_factor'], 'score', 5)} FROM sim GROUP BY symbol, perm_id")
def signal_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strategies.ma_crossover_frame(hourly(spark, sf_dir), 10, 30)
    return rounded(mcpt.signal_scores(s, _perms(spark)).select("symbol", "perm_id", "score"), 5)


_PERM_ALL = f"""{_permuted(False, 4, TRAIN)},
every AS (SELECT symbol || '|' || perm_id AS symbol, bar_idx, close FROM perm UNION ALL SELECT symbol || '|' || perm_id, bar_idx, close FROM bars, (SELECT unnest(range(4)) AS perm_id) WHERE bar_idx < {TRAIN} UNION ALL SELECT symbol || '|-1', bar_idx, close FROM bars)"""
_WFM = _WF.replace("FROM bars", "FROM every").replace("ORDER BY sharpe_ratio DESC", "ORDER BY profit_factor DESC")


@query(f"WITH {H}, {_PERM_ALL}, {_WFM}, each_ AS (SELECT split_part(symbol, '|', 1) AS symbol, CAST(split_part(symbol, '|', 2) AS BIGINT) AS perm_id, avg(oos_profit_factor) FILTER (oos_profit_factor < 'Infinity'::DOUBLE) AS score FROM best GROUP BY 1, 2) SELECT e.symbol, e.perm_id, {r('e.score', 'score', 5)}, {r('o.score', 'original_score', 5)} FROM each_ e JOIN each_ o ON o.symbol = e.symbol AND o.perm_id = -1 WHERE e.perm_id >= 0")
def walk_forward_mcpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean out-of-sample profit factors of walk-forwards on permuted bars, beside that on the real ones."""
    few = _perms(spark).filter("perm_id < 4")
    s = mcpt.walk_forward_scores(hourly(spark, sf_dir), _grid(spark), "ma_crossover", few, TRAIN, TEST)
    return rounded(s.select("symbol", "perm_id", "score", "original_score"), 5)


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hourly(spark, sf_dir).select("symbol", X.pct_change("close", X.series()).alias("x"))
    return rounded(b.dropna(), 9)


_RET = f"v AS (SELECT symbol, round(close / lag(close) OVER ({W}) - 1, 9) + 0.0 AS x FROM bars), x_ AS (SELECT * FROM v WHERE x IS NOT NULL)"


def _histogram_sql(k: str) -> str:
    return f"""e AS (SELECT symbol, min(x) AS a, max(x) AS b, count(x) AS total, {k} AS k FROM x_ GROUP BY symbol), p AS (SELECT symbol, CAST(least(floor((x - a) / ((b - a) / k)), k - 1) AS INT) AS bin, a, b, k, total FROM x_ JOIN e USING (symbol))
SELECT symbol, bin, {r('a + bin * ((b - a) / k)', 'low')}, {r('a + (bin + 1) * ((b - a) / k)', 'high')}, count(*) AS n, {r('count(*) / (total * ((b - a) / k))', 'density')} FROM p GROUP BY symbol, bin, a, b, k, total"""


@query(f"WITH {H}, {_RET}, {_histogram_sql('50')}")
def histogram_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.histogram(_returns(spark, sf_dir), "x", 50, ("symbol",)))


@query(f"WITH {H}, {_RET}, {_histogram_sql('greatest(least(floor(log2(count(x)) + 1), count(DISTINCT x), 50), 10)')}")
def histogram_sturges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.histogram(_returns(spark, sf_dir), "x", stats.dynamic_bins("x"), ("symbol",)))


@query(f"WITH {H}, {_RET}, s AS (SELECT symbol, min(x) AS a, max(x) AS b, stddev_samp(x) * pow(count(x)::DOUBLE, -0.2::DOUBLE) AS h FROM x_ GROUP BY symbol), g AS (SELECT symbol, h, CAST(i AS INT) AS point, a + i * (b - a) / 199 AS gx FROM s, range(200) t(i)) SELECT g.symbol, point, {r('gx', 'x')}, {r('avg(exp(-((gx - x) / h) * ((gx - x) / h) / 2)) / max(h) / sqrt(2 * pi())', 'density')} FROM g JOIN x_ ON g.symbol = x_.symbol GROUP BY g.symbol, point, gx")
def kde_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.density(_returns(spark, sf_dir), "x", ("symbol",)))


@query(f"WITH {H}, {_MCPT}, x_ AS (SELECT symbol, score AS x FROM scored), {_histogram_sql('5')}")
def report_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table behind a chart of permutation scores."""
    return rounded(report.score_distribution(_scores(spark, sf_dir), 5))


__all__ = ["COUNTS", "M", "metric_columns"]
