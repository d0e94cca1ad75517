"""Indicators of the time of day against plain Python."""

from statistics import median

import pytest

from candleforge.operators import seasonal


def test_slots_and_ranges(spark):
    rows = [("A", i * 3_600, 10.0 + (i * 7 % 13), 9.0 - (i % 5)) for i in range(200) if i % 11] + [("B", 0, 2.0, 1.0), ("B", 3_600, None, 1.0)]
    bars = spark.createDataFrame(rows, "symbol string, t long, high double, low double")
    slots = {(x["instance"], x["symbol"], x["t"]): x["value"] for x in seasonal.day_slot(bars).collect()}
    assert slots == {(f"day_slot__slot{k}", s, t): float(t % 86_400 // 14_400 == k) for s, t, _, _ in rows for k in range(6)}
    found = {(x["symbol"], x["t"]): x["value"] for x in seasonal.vol_deseason(bars, days=(4,)).collect()}
    past = {}
    for s, t, high, low in rows:
        own, size = past.setdefault((s, t % 86_400 // 14_400), []), None if high is None else high - low
        full = len(own) >= 4 and None not in own[-4:] and size is not None
        assert found[s, t] == (pytest.approx(size / median(own[-4:])) if full else None)
        own.append(size)
    assert len(found) == len(rows)


def test_empty_table(spark):
    bars = spark.createDataFrame([], "symbol string, t long, high double, low double")
    assert seasonal.day_slot(bars).isEmpty() and seasonal.vol_deseason(bars).isEmpty()
