"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

import pytest

from conftest import rows_of, same
from tidemark import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, duck):
    sized = sf_dir if name in catalog.ORACLE_SQL else sf_dir.replace("sf0.001", "sf0.01")
    got = catalog.QUERIES[name](spark, sized).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert same(rows_of(got), rows_of(want))


def test_entry_module_has_all_queries():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_windows_of_one_series_share_an_exchange(spark, sf_dir, capsys):
    from tidemark.queries.signals import strategy_ma_crossover

    plan = strategy_ma_crossover(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") <= 3  # ticks to bars, and bars to series
    assert "Python" not in plan and "Arrow" not in plan


def test_full_signal_shuffle_goes_on_from_the_checked_one(spark, sf_dir):
    few, full = (catalog.QUERIES[x](spark, sf_dir).toPandas() for x in ("signal_shuffle", "signal_shuffle_full"))
    assert len(few) and (full.groupby("symbol").perm_id.nunique() == 1000).all() and len(full) == 1000 * few.symbol.nunique()
    assert same(rows_of(full[full.perm_id.isin(few.perm_id)]), rows_of(few))


def test_full_walk_forward_goes_on_from_few(spark, sf_dir):
    from tidemark.plans import mcpt
    from tidemark.queries import plans
    from tidemark.queries.base import hourly

    bars = hourly(spark, sf_dir).filter("symbol = 'click'").cache()
    few, full = (mcpt.walk_forward_scores(bars, plans._grid(spark), "ma_crossover", plans._perms(spark, n), 100, 40).toPandas() for n in (4, plans.N_WALK_FORWARD))
    assert len(few) == 4 and sorted(full.perm_id) == list(range(200))
    assert same(rows_of(full[full.perm_id < 4]), rows_of(few))


def test_full_reoptimisation_against_brute_force(spark, sf_dir):
    import numpy as np
    import pandas as pd

    from tidemark.operators.permutation import permuted_arrays
    from tidemark.queries.base import hourly

    def score(close, short, long):
        c = pd.Series(close)
        fast, slow = c.rolling(short).mean().round(6), c.rolling(long).mean().round(6)
        f0, s0 = fast.shift(), slow.shift()
        signal = pd.Series(np.where((f0 <= s0) & (fast > slow), 1.0, np.where((f0 >= s0) & (fast < slow), -1.0, np.nan))).ffill().fillna(0)
        position = signal.shift().fillna(0)
        ret = (position * (c / c.shift() - 1) - (signal - position).abs() * 0.0007).fillna(0)
        won, lost = ret[ret > 0].sum(), -ret[ret < 0].sum()
        return won / lost if lost else np.inf if won else 0.0

    got = catalog.QUERIES["mcpt_reoptimized_full"](spark, sf_dir).toPandas()
    assert (got.groupby("symbol").perm_id.nunique() == 500).all()
    grid = [(s, lo) for s in (5, 10, 15) for lo in (10, 20, 30) if s < lo]
    symbol = got.symbol.min()
    bars = hourly(spark, sf_dir).filter(f"symbol = '{symbol}'").toPandas().sort_values("bar_idx")
    a = {c: bars[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")}
    rows = got[got.symbol == symbol].set_index("perm_id")
    assert rows.original_score.iloc[0] == pytest.approx(max(score(a["close"], *p) for p in grid), abs=1e-4)
    for i in (0, 7, 499):
        assert rows.score[i] == pytest.approx(max(score(permuted_arrays(a, i)["close"], *p) for p in grid), abs=1e-4)
    assert catalog.QUERIES["mcpt_pvalue_corrected_full"](spark, sf_dir).toPandas().p_value.between(1 / 1001 - 1e-6, 1).all()


def test_feature_windows_of_all_features(spark, sf_dir):
    import numpy as np

    from tidemark.operators import folds
    from tidemark.queries.base import hourly

    pack = folds.indicator_pack(hourly(spark, sf_dir)).toPandas().sort_values(["symbol", "bar_idx"])
    full = catalog.QUERIES["feature_windows_full"](spark, sf_dir).toPandas().set_index(["symbol", "bar_idx"])
    got = {(r.symbol, r.bar_idx): np.array(r.features) for r in folds.feature_windows(folds.indicator_pack(hourly(spark, sf_dir)), 24).collect()}
    n = 0
    for symbol, g in pack.groupby("symbol"):
        every = [*folds.FEATURES, "sma_5", "sma_10", "sma_20"]
        g = g.set_index("bar_idx")[every].astype(float).ffill().dropna()
        for i in range(24, len(g)):
            x = g.iloc[i - 24 : i][list(folds.FEATURES)].to_numpy()
            span = np.ptp(x, axis=0)
            want, key = (x - x.min(axis=0)) / np.where(span > 0, span, 1), (symbol, g.index[i])
            assert got[key].shape == (24, 12) and np.allclose(got[key], want, atol=1e-6)
            assert np.allclose(full.loc[key, list(folds.FEATURES)].astype(float), want.sum(axis=0), atol=2e-4)
            n += 1
    assert n and len(got) == len(full) == n
