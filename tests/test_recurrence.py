import random

import pytest
from pyspark.sql import functions as F

from candleforge.functions import recurrence
from candleforge.operators import exits


@pytest.mark.parametrize("length", [3, 16, 1000])
def test_affine_scan_equals_loop(spark, length):
    rng = random.Random(3)
    rows = [(k, 60 * t, rng.choice([0.0, 0.5, 0.9, 1.0, -0.4, None]), rng.choice([rng.gauss(0, 1), None])) for k in "xy" for t in range(100 if k == "x" else 7)]
    got = recurrence.affine_scan(spark.createDataFrame(rows, "symbol string, t long, a double, b double").repartition(5), F.col("a"), F.col("b"), "y", length=length).collect()
    want, y = {}, {"x": 0.0, "y": 0.0}
    for k, t, a, b in rows:
        y[k] = (1.0 if a is None else a) * y[k] + (b or 0.0)
        want[k, t] = y[k]
    assert {(r.symbol, r.t): pytest.approx(r.y) for r in got} == want


@pytest.mark.parametrize("length", [4, 1000])
def test_wilder_equals_loop(spark, length):
    rng = random.Random(4)
    rows = [(k, 60 * t, None if t == 0 or rng.random() < 0.1 else rng.gauss(1, 1)) for k, m in (("x", 80), ("y", 5), ("z", 4)) for t in range(m)]
    n = 4
    got = {(r.symbol, r.t): r.w for r in recurrence.wilder(spark.createDataFrame(rows, "symbol string, t long, v double"), F.col("v"), n, "w", length=length).collect()}
    seen, mean = {}, {}
    for k, t, v in rows:
        if v is not None:
            seen.setdefault(k, []).append(v)
            if len(seen[k]) == n:
                mean[k] = sum(seen[k]) / n
            elif len(seen[k]) > n:
                mean[k] = (mean[k] * (n - 1) + v) / n
        assert got[k, t] == (pytest.approx(mean[k]) if k in mean else None)


@pytest.mark.parametrize("length", [2, 5, 64, 4096])
def test_walk_totals_equal_fold(spark, length):
    rng = random.Random(5)
    rows = []
    for k, n in (("x", 200), ("y", 3), ("z", 90)):
        for i in range(n):
            if not (k == "z" and 20 < i < 60) and rng.random() < 0.8:
                rows.append((k, i, i + rng.randrange(0, 12), rng.gauss(0, 1)))
    frame = spark.createDataFrame(rows, "symbol string, bar long, exit_bar long, y double").repartition(4)
    got = {r.symbol: (round(r.total, 9), r.n) for r in recurrence.walk_totals(frame, length=length).collect()}
    assert got == {r.symbol: (round(r.total, 9), r.n) for r in exits.walk(frame).collect()}
    assert recurrence.walk_totals(frame.limit(0), length=length).count() == 0
