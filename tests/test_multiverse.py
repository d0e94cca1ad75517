import hashlib
import math

import numpy as np
import pytest

from candleforge.operators import multiple_testing, multiverse

COLUMNS = "symbol string, t long, open double, high double, low double, close double, volume double, high_time long, low_time long"


def series(symbol: str, times: list[int], seed: int):
    rng, close, out = np.random.default_rng(seed), 50.0, []
    for t in times:
        open_ = close * math.exp(rng.normal(0, 0.01))
        close = open_ * math.exp(rng.normal(0, 0.02))
        out.append((symbol, 3600 * t, open_, max(open_, close) * 1.01, min(open_, close) * 0.99, close, float(t), 3600 * t + 60, None))
    return out


def number(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("length", [9, 1000])
def test_paths_share_the_order_of_blocks(spark, length, monkeypatch):
    monkeypatch.setattr(multiverse, "TOGETHER", 3)
    times = {"a": list(range(60)), "b": [t for t in range(5, 75) if t % 7 and not 20 < t < 41]}
    rows = {s: series(s, ts, i) for i, (s, ts) in enumerate(times.items())}
    got = multiverse.joint_paths(spark.createDataFrame(rows["a"] + rows["b"], COLUMNS), 4, 6, 42, length).collect()
    line = sorted(set(times["a"]) | set(times["b"]))
    for path in range(1, 5):
        phase = number(42, path, "phase") % 6
        block = [0 if i < phase else (phase > 0) + (i - phase) // 6 for i in range(len(line))]
        place = {b: k for k, b in enumerate(sorted(set(block), key=lambda b: (number(42, path, b), b)))}
        for s, own in rows.items():
            at = {line[i]: (place[block[i]], i) for i in range(len(line))}
            order = sorted(range(len(own)), key=lambda k: at[own[k][1] // 3600])
            close, want = own[0][2], []
            for k, to in zip(order, own, strict=True):
                _, t, o, h, low, c, v, ht, _ = own[k]
                close *= c / (own[k - 1][5] if k else o)
                want.append((to[1], close * o / c, close * h / c, close * low / c, close, v, to[1] + ht - t, None))
            mine = sorted((r.t, r.open, r.high, r.low, r.close, r.volume, r.high_time, r.low_time) for r in got if (r.path, r.symbol) == (path, s))
            assert [tuple(x if x is None else pytest.approx(x) for x in w) for w in want] == mine


def test_p_counts_the_path_itself(spark):
    real = spark.createDataFrame([("x", 2.0), ("y", 9.0)], "symbol string, value double")
    null = spark.createDataFrame([(i, s, float(i)) for i in range(4) for s in "xy"], "path long, symbol string, value double")
    got = {r.symbol: r.p for r in multiverse.permutation_pvalues(real, null, ["symbol"], 4).collect()}
    assert got == {"x": 3 / 5, "y": 1 / 5}


def test_equal_results_have_equal_means(spark):
    """Means of 146 equal results and of other numbers of them differ by the rounding of their sums."""
    y = 15.0 - 0.005 * (2 + 15.0 / 100.0)
    rows = [(0, "a", y)] * 146 + [(p, "a", y) for p in range(1, 41) for _ in range(100 + p)]
    means = spark.createDataFrame(rows, "path long, symbol string, y double").groupBy("path", "symbol").agg(multiverse.exact_mean("y").alias("value"))
    real, null = means.filter("path = 0").select("symbol", "value"), means.filter("path > 0")
    assert [(r.value, r.p) for r in multiverse.permutation_pvalues(real, null, ["symbol"], 40).collect()] == [(y, 1.0)]


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    z, dev = rng.normal(0, 1, 37), rng.normal(0, 1, (37, 25))
    columns = spark.createDataFrame([(i, float(z[i]), dev[i].tolist()) for i in range(37)], "col long, z double, deviation array<double>")
    got = {r.percentile: (r.real, r.simulated, r.below) for r in multiple_testing.percentile_bootstrap(columns, "col").collect()}
    for p in multiple_testing.PERCENTILES:
        real, null = np.percentile(z, p), np.percentile(dev, p, axis=0)
        assert got[p] == (pytest.approx(real), pytest.approx(null.mean()), pytest.approx(100 * (null < real).mean()))
