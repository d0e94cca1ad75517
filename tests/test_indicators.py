"""Indicators against plain Python over the same bars."""

import math
import random

import pytest

from candleforge.operators.indicators import REGISTRY, decay, instance_key, slope_weights, with_indicator


@pytest.fixture(scope="module")
def series():
    rng = random.Random(5)
    rows, close = [], 50.0
    for t in range(160):
        open_ = close
        close = max(1.0, close + rng.uniform(-2, 2))
        high, low = max(open_, close) + rng.random(), min(open_, close) - rng.random() * 0.5
        rows.append(("s", t * 3600, open_, high, low, close, 1.0))
    return rows


@pytest.fixture(scope="module")
def bars(spark, series):
    return spark.createDataFrame(series, "symbol string, t long, open double, high double, low double, close double, volume double").cache()


def values(bars, name, params):
    return [r.value for r in with_indicator(bars, name, params).orderBy("t").collect()]


def check(got, expected):
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert (g is None) == (e is None)
        assert g is None or math.isclose(g, e, rel_tol=1e-9, abs_tol=1e-9)


def fir(x, weights):
    n = len(weights)
    return [None if i < n - 1 or any(v is None for v in x[i - n + 1 : i + 1]) else sum(w * x[i - k] for k, w in enumerate(weights)) for i in range(len(x))]


def ranges(series):
    return [None] + [max(b[3] - b[4], abs(b[3] - a[5]), abs(b[4] - a[5])) for a, b in zip(series, series[1:], strict=False)]


def test_rsi(bars, series):
    c = [r[5] for r in series]
    up = [None] + [max(b - a, 0.0) for a, b in zip(c, c[1:], strict=False)]
    down = [None] + [max(a - b, 0.0) for a, b in zip(c, c[1:], strict=False)]
    u, d = fir(up, decay(1 / 14, 99)), fir(down, decay(1 / 14, 99))
    check(values(bars, "rsi", {"period": 14}), [None if x is None else 100.0 if y == 0 else 100 - 100 / (1 + x / y) for x, y in zip(u, d, strict=True)])


def test_bands_and_atr_distance(bars, series):
    c = [r[5] for r in series]
    expected = []
    for i in range(len(c)):
        w = c[i - 9 : i + 1] if i >= 9 else None
        if w:
            m = sum(w) / 10
            s = math.sqrt(sum((v - m) ** 2 for v in w) / 10)
            expected.append((c[i] - (m - 2 * s)) / (4 * s))
        else:
            expected.append(None)
    check(values(bars, "bb_pctb", {"n": 10}), expected)
    atr = fir(ranges(series), decay(1 / 14, 99))
    check(values(bars, "acceleration", {}), [None if a is None else (c[i] - 2 * c[i - 1] + c[i - 2]) / a for i, a in enumerate(atr)])


def test_rank_and_density(bars, series):
    c = [r[5] for r in series]
    rank = [None if i < 99 else (sum(v < c[i] for v in c[i - 99 : i + 1]) + (sum(v == c[i] for v in c[i - 99 : i + 1]) + 1) / 2) for i in range(len(c))]
    check(values(bars, "close_pct_rank", {"period": 100}), rank)
    inside = [None if i < 50 else sum(r[4] <= c[i] <= r[3] for r in series[i - 50 : i]) / 50 for i in range(len(c))]
    check(values(bars, "tpo_density", {"period": 50}), inside)


def test_entropy(bars, series):
    c = [r[5] for r in series]
    ret = [None] + [math.log(b / a) for a, b in zip(c, c[1:], strict=False)]
    out = []
    for i in range(len(c)):
        w = ret[i - 29 : i + 1]
        if i < 30:
            out.append(None)
            continue
        low, width = min(w), (max(w) - min(w)) / 10
        counts = [0] * 10
        for v in w:
            counts[min(9, int((v - low) / width))] += 1
        out.append(-sum(k / 30 * math.log(k / 30) for k in counts if k))
    check(values(bars, "return_entropy", {"period": 30}), out)


def test_slope_weights_are_the_filter():
    def last_slope(x, q=1e-5, r=1e-2):
        level, slope, p = x[0], 0.0, [[1.0, 0.0], [0.0, 1.0]]
        for v in x:
            level += slope
            p = [[p[0][0] + p[1][0] + p[0][1] + p[1][1] + q, p[0][1] + p[1][1]], [p[1][0] + p[1][1], p[1][1] + q]]
            k0, k1 = p[0][0] / (p[0][0] + r), p[1][0] / (p[0][0] + r)
            e = v - level
            level, slope = level + k0 * e, slope + k1 * e
            p = [[p[0][0] * (1 - k0), p[0][1] * (1 - k0)], [p[1][0] - k1 * p[0][0], p[1][1] - k1 * p[0][1]]]
        return slope

    rng = random.Random(1)
    x = [rng.uniform(10, 20) for _ in range(100)]
    assert math.isclose(last_slope(x), sum(w * x[-1 - k] for k, w in enumerate(slope_weights(1e-5, 1e-2, 100))), rel_tol=1e-9)


def test_registry_keys():
    assert len(REGISTRY) == 37
    assert instance_key("macd_hist", {"slow": 26, "fast": 6}) == "macd_hist__fast6_slow26"
    assert [k for k, _ in REGISTRY["tsi"].instances()] == ["tsi__long25_short13", "tsi__long25_short26", "tsi__long50_short13", "tsi__long50_short26"]
