import random

import pytest
from pyspark.sql import functions as F

from candleforge.functions import stretches
from candleforge.operators import etl, exits
from candleforge.operators.indicators import REGISTRY, with_indicator


@pytest.fixture(scope="module")
def candles(spark):
    rng = random.Random(3)
    rows = []
    for symbol, n in (("a", 900), ("b", 201), ("c", 1)):
        t, close = 0, 100.0
        for _ in range(n):
            t += rng.choice([3600, 3600, 3600, 7200, 40 * 86_400])
            open_, close = close, close * (1 + rng.uniform(-0.02, 0.02))
            rows.append((symbol, t, open_, max(open_, close) + rng.random(), min(open_, close) - rng.random(), close, float(rng.choice([0, 0, 0, 5, 9])), t + rng.randrange(3600), t + rng.randrange(3600)))
    return spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double, high_time long, low_time long").cache()


def test_numbers_follow_time(candles):
    got = stretches.numbered(candles).select("symbol", "t", "_bar").collect()
    for symbol in "abc":
        own = sorted((r.t, r._bar) for r in got if r.symbol == symbol)
        assert [b for _, b in own] == list(range(len(own)))


def test_stretches_copy_the_neighbours(candles):
    rows = stretches.stretched(candles, back=7, ahead=3, length=50)
    assert rows.filter("_own").count() == candles.count()
    sizes = {(r.symbol, r._stretch): r.n for r in rows.groupBy("symbol", "_stretch").agg(F.count("*").alias("n")).collect()}
    assert sizes["a", 1] == 60 and sizes["a", 0] == 53 and max(sizes.values()) == 60


@pytest.mark.parametrize("name", ["adx", "tsi", "vol_of_vol", "atr_regime", "tpo_density", "trend_intensity_index", "kalman_slope", "return_entropy"])
def test_indicators_of_short_stretches_equal_those_of_one(candles, name):
    params = REGISTRY[name].instances()[-1][1]

    def values(length):
        rows = with_indicator(candles.select("symbol", "t", "open", "high", "low", "close", "volume"), name, params, length=length)
        return {(r.symbol, r.t): r.value for r in rows.collect()}

    short, whole = values(200), values(100_000)
    assert short.keys() == whole.keys() and sum(v is not None for v in whole.values()) > 500
    assert all(short[k] == pytest.approx(v, rel=1e-9, abs=1e-9) if v is not None else short[k] is None for k, v in whole.items())


def test_targets_entries_and_gaps_of_short_stretches(candles, monkeypatch):
    def results():
        return [sorted(map(tuple, df.collect()), key=str) for df in (exits.targets(candles, 10, 3.0, 3.0), exits.entries(candles, 10, 3.0, 3.0), etl.gaps(candles, 3600))]

    whole = results()
    monkeypatch.setattr(stretches, "LENGTH", 40)
    assert results() == whole


def test_volume_is_carried_over_buckets(candles):
    expected, last = {}, {}
    rows = sorted(candles.collect(), key=lambda r: (r.symbol, r.t))
    first = {}
    for r in rows:
        if r.volume:
            first.setdefault(r.symbol, r.volume)
    for r in rows:
        last[r.symbol] = r.volume or last.get(r.symbol)
        expected[r.symbol, r.t] = last[r.symbol] or first.get(r.symbol, 0.0)
    assert {(r.symbol, r.t): r.volume for r in etl.fill_volume(candles).collect()} == expected
