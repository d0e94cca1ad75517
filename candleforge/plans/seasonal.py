"""Registered queries of the indicators of the time of day, with DuckDB text."""

from __future__ import annotations

from candleforge.operators import seasonal
from candleforge.plans.catalog import H1, query, r
from candleforge.sources.bars import bars

_SECONDS = seasonal.SLOT_HOURS * 3_600


@query(f"SELECT 'day_slot__slot' || s AS instance, symbol, t, CASE WHEN t % 86400 // {_SECONDS} = s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM {H1}, range({len(seasonal.SLOTS)}) x(s)")
def ind_day_slot(spark, sf_dir):
    return seasonal.day_slot(bars(spark, sf_dir))


def _deseason_sql(n: int) -> str:
    median = f"(list_sort(list(range_) OVER w)[{(n - 1) // 2 + 1}] + list_sort(list(range_) OVER w)[{n // 2 + 1}]) / 2"
    return f"""SELECT 'vol_deseason__days{n}' AS instance, symbol, t, round(CASE WHEN abs(median) > 1e-15 THEN range_ / median END, 6) AS value
 FROM (SELECT *, CASE WHEN count(range_) OVER w = {n} THEN {median} END AS median FROM (SELECT symbol, t, high - low AS range_, t % 86400 // {_SECONDS} AS slot FROM {H1})
  WINDOW w AS (PARTITION BY symbol, slot ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))"""


@query(" UNION ALL ".join(_deseason_sql(n) for n in seasonal.DAYS))
def ind_vol_deseason(spark, sf_dir):
    return seasonal.vol_deseason(bars(spark, sf_dir)).select("instance", "symbol", "t", r("value"))
