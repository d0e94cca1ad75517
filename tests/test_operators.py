"""Operators on small frames with hand-computed results, and the registered queries against DuckDB."""

import random
import math

import duckdb
import numpy as np
import pytest

from candleforge.operators import etl, exits, rules, stats, trades, walkforward
from candleforge.plans import catalog

BAR = "symbol string, t long, open double, high double, low double, close double, volume double"
SF = "/root/testdata/sf0.001"
TABLES = "orders lineitem events".split()


def test_fill_volume(spark):
    rows = [("a", i, 1.0, 1.0, 1.0, 1.0, v) for i, v in enumerate([0.0, None, 5.0, 0.0, 7.0])] + [("b", 0, 1.0, 1.0, 1.0, 1.0, None)]
    got = {(r.symbol, r.t): r.volume for r in etl.fill_volume(spark.createDataFrame(rows, BAR)).collect()}
    assert [got["a", i] for i in range(5)] == [5.0, 5.0, 5.0, 5.0, 7.0] and got["b", 0] == 0.0


def test_intrabar_extremes_take_the_first(spark):
    fine = [("a", i * 3600, 1.0, h, lo, 1.0, 1.0) for i, (h, lo) in enumerate([(3, 1), (5, 0), (5, 0), (4, 2), (9, 9), (9, 9), (9, 9), (9, 9)])]
    coarse = [("a", 0, 1.0, 5.0, 0.0, 1.0, 1.0), ("a", 14400, 1.0, 9.0, 9.0, 1.0, 1.0)]
    got = etl.intrabar_extremes(spark.createDataFrame(coarse, BAR), spark.createDataFrame([(r[0], r[1], *map(float, r[2:])) for r in fine], BAR), 14400).collect()
    assert [(r.t, r.high_time, r.low_time) for r in got] == [(0, 3600, 3600)]


def test_weekend_gap(spark):
    friday, monday = 4 * 86400 - 3 * 86400 + 0, 4 * 86400
    rows = [("a", friday, *[1.0] * 5), ("a", monday, *[1.0] * 5)]
    df = spark.createDataFrame(rows, BAR)
    assert etl.gaps(df, 3600).count() == 1 and etl.gaps(df, 3600, forex=True).count() == 0


def test_trading_index_rolls_weekends_back(spark):
    from pyspark.sql import functions as F

    days = list(range(0, 40))
    got = [r[0] for r in spark.createDataFrame([(d,) for d in days], "d long").select(trades.trading_index(F.col("d"))).collect()]
    expected = [int(np.busday_count("1970-01-05", np.busday_offset(np.datetime64("1970-01-01") + d, 0, roll="backward"))) for d in days]
    assert got == expected


EXT = BAR + ", high_time long, low_time long"


def candle(t, o, h, lo, c, ht=None, lt=None):
    return ("a", t, float(o), float(h), float(lo), float(c), 1.0, ht, lt)


def test_ties_differ_between_screening_and_simulation(spark):
    rows = [candle(0, 100, 100, 100, 100), candle(10, 100, 120, 80, 100, 12, 12), candle(20, 100, 100, 100, 100), candle(30, 100, 100, 100, 100)]
    df = spark.createDataFrame(rows, EXT)
    screened = {r.t: r for r in exits.targets(df, 2, 10.0, 10.0).collect()}
    assert screened[0].kind == "SL" and screened[0].exit_bar == 1 and screened[10].kind == "TIME"
    assert math.isclose(screened[0].y, -10 - 0.005 * 1.9)
    simulated = {r.t: r for r in exits.entries(df, 2, 10.0, 10.0).collect()}
    assert simulated[10].exit_reason == "TP" and simulated[10].sell_t == 12 and simulated[10].sell_price == pytest.approx(110.0)
    assert simulated[0].exit_reason == "TP" and simulated[20].exit_reason == "END_OF_DATA"


def test_walk_skips_overlaps(spark):
    df = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 1, 2, 10.0), ("a", 2, 4, 2.0), ("a", 6, 6, 4.0)], "symbol string, bar long, exit_bar long, y double")
    assert tuple(exits.walk(df).first()) == ("a", 7.0, 3)


def test_ninth_position_is_the_last_that_fits(spark):
    events = spark.createDataFrame([(1, f"s{i:02d}", 0, 0) for i in range(12)], "rule_id long, symbol string, t long, bar long")
    ends = spark.createDataFrame([(f"s{i:02d}", 0, 100.0, 50, 101.0, "SELL_AFTER") for i in range(12)], "symbol string, t long, buy_price double, sell_t long, sell_price double, exit_reason string")
    log = exits.simulate(events, ends, True).collect()
    assert sorted(r.symbol for r in log) == [f"s{i:02d}" for i in range(9)]
    assert log[0].profit == pytest.approx(10 - 0.05 - 1010 * 0.00005)


def test_no_pyramid_waits(spark):
    events = spark.createDataFrame([(1, "a", t, t) for t in (0, 5, 10, 11)], "rule_id long, symbol string, t long, bar long")
    ends = lambda reason: spark.createDataFrame([("a", t, 100.0, t + 10, 101.0, reason) for t in (0, 5, 10, 11)], "symbol string, t long, buy_price double, sell_t long, sell_price double, exit_reason string")
    assert [r.buy_t for r in exits.simulate(events, ends("SELL_AFTER"), False).collect()] == [0, 10]
    assert [r.buy_t for r in exits.simulate(events, ends("TP"), False).collect()] == [0, 11]
    assert [r.buy_t for r in exits.simulate(events, ends("TP"), True).collect()] == [0, 5, 10, 11]


def test_bootstrap_weights_sum_to_days():
    for days, block in ((7, 3), (30, 10), (5, 9), (128, 1)):
        w = stats.bootstrap_weights(days, block, 50)
        assert (w.sum(axis=1) == days).all() and (w >= 0).all()
    assert (stats.bootstrap_weights(20, 4, 9) == stats.bootstrap_weights(20, 4, 9)).all()


def test_step_down_is_monotone(spark):
    rng = np.random.default_rng(1)
    rows = [(f"k{i}", float(z), rng.normal(size=100).tolist()) for i, z in enumerate([3.5, 1.0, 0.2, -1.0])]
    df = spark.createDataFrame([(k, 0.0, z, d) for k, z, d in rows], "strategy string, sharpe double, z double, deviation array<double>")
    got = {r.strategy: r.p for r in stats.step_down(df, "strategy").collect()}
    p, expected = 0.0, {}
    ordered = sorted(rows, key=lambda x: -x[1])
    for i, (k, z, _) in enumerate(ordered):
        p = max(p, float((np.max([d for _, _, d in ordered[i:]], axis=0) >= z).mean()))
        expected[k] = p
    assert got == pytest.approx(expected)


def test_windows_end_with_the_data():
    assert walkforward.windows(100, 50, 20) == [(10, 60, 60, 80), (30, 80, 80, 100)]
    assert all(w[3] <= 100 and w[0] >= 0 for w in walkforward.windows(100, 40, 7))


def test_smoothing_snaps_to_the_grid(spark):
    df = spark.createDataFrame([(0, 20.0), (1, 100.0), (2, 40.0)], "win long, param double")
    row = walkforward.smoothed(df, [20.0, 40.0, 100.0]).first()
    assert row["mean"] == pytest.approx(0.3 * 40 + 0.7 * (0.3 * 100 + 0.7 * 20)) and row["param"] == 40.0


def test_greedy():
    assert rules.greedy([1, 2, 3, 4], {(1, 2), (4, 3)}) == [1, 3]


def test_deflated_sharpe_falls_with_trials():
    one, many = (stats.deflated_sharpe(0.1, 500, 0.0, 3.0, n, 0.05) for n in (2, 1000))
    assert 0 < many < one < 1


def rows_of(columns, records):
    def plain(v):
        return None if v is None else float(v) if isinstance(v, float) else v

    return sorted(repr(tuple(plain(r[c]) for c in columns)) for r in records)


SAMPLE = ["bars_4h", "clean_volume", "intrabar_extremes", "global_timeline", "rule_events", "jaccard_pairs", "first_touch_targets", "segment_edges", "strategy_metrics", "weekly_equity", "corr_pairs", "wfo_test", "ind_adx", "ind_tsi"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    result = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    theirs = [dict(zip(result.columns, r, strict=True)) for r in result.fetchall()]
    assert rows_of(columns, [r.asDict() for r in df.collect()]) == rows_of(columns, theirs)


def test_streams_equal_batch(spark):
    batch = {(r.symbol, r.t): r.close for r in catalog.QUERIES["bars_4h"](spark, SF).collect()}
    streamed = {(r.symbol, r.t): r.close for r in catalog.QUERIES["stream_closed_bars"](spark, SF).collect()}
    assert streamed and all(batch[k] == v for k, v in streamed.items())
    assert len(batch) - len(streamed) <= 5
    assert {r.reason for r in catalog.QUERIES["stream_monitor"](spark, SF).collect()} <= {"TP", "SL", "TIMEOUT"}


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_recentred_deviations_and_flat_columns(spark):
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    days = 120
    columns = {"good": rng.normal(0.3, 1, days), "poor": rng.normal(-1.5, 1, days), "flat": np.zeros(days)}
    daily = spark.createDataFrame([(k, i, float(v)) for k, x in columns.items() for i, v in enumerate(x)], "strategy string, idx long, profit double")
    got = {r.strategy: r for r in stats.sharpe_deviations(daily, "strategy", days, 0, replicas=200).collect()}
    w = stats.bootstrap_weights(days, replicas=200)
    for name in ("good", "poor"):
        x = columns[name]
        ratio = lambda m, q: m / np.sqrt((q - m * m) * days / (days - 1))
        dev = ratio(w @ x / days, w @ (x * x) / days) - ratio(x.mean(), (x * x).mean())
        z = ratio(x.mean(), (x * x).mean()) / dev.std(ddof=1)
        expected = dev / dev.std(ddof=1) + (z if z < -math.sqrt(2 * math.log(math.log(days))) else 0.0)
        assert np.isclose(got[name].z, z) and np.allclose(got[name].deviation, expected)
    assert got["poor"].z < -5 and got["flat"].z == 0.0 and all(d == -math.inf for d in got["flat"].deviation)


def test_portfolios_and_places(spark):
    from itertools import combinations

    from candleforge.operators import walkforward

    ids = spark.createDataFrame([(i, f"s{i}") for i in range(6)], "idx long, strategy string")
    sets = {}
    for r in walkforward.portfolios(ids, 2, 4).collect():
        sets.setdefault(r.combo, set()).add(r.strategy)
    assert sorted(map(sorted, sets.values())) == sorted(list(c) for k in (2, 3, 4) for c in combinations([f"s{i}" for i in range(6)], k))
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 2.0, rng.random(), rng.random() * 50])) for i in range(700)]
    got = {r.id: r.place for r in walkforward.placed(spark.createDataFrame(rows, "id long, v double"), "v", "id", "place", 16).collect()}
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0.0), x[0]))
    assert got == {i: k + 1 for k, (i, _) in enumerate(order)}
