"""Indicators of the time of day: the slot that a bar opens in, and its range against the same slot's days before.

Defined results: a bar without high or low, or with too few bars of its slot before it, or with a median of 0, has no
value; every bar has a slot. Windows go over stretches of a symbol's slot, not over whole series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.functions.rolling import TINY
from candleforge.operators.reports import slot_medians

#: Hours of a slot, slots of a day, and bars of the same slot that the median takes. Fixed values.
SLOT_HOURS, SLOTS, DAYS = 4, (0, 1, 2, 3, 4, 5), (10, 16)


def day_slot(bars: DataFrame, hours: int = SLOT_HOURS, slots: tuple[int, ...] = SLOTS) -> DataFrame:
    """(instance, symbol, t, value): 1 where the bar opens in the slot, else 0, for each slot."""
    own = F.floor(F.pmod("t", F.lit(86_400)) / (3_600 * hours))
    points = [F.struct(F.lit(f"day_slot__slot{s}").alias("instance"), F.when(own == s, 1.0).otherwise(0.0).alias("value")) for s in slots]
    return bars.select("symbol", "t", F.inline(F.array(*points))).select("instance", "symbol", "t", "value")


def vol_deseason(bars: DataFrame, hours: int = SLOT_HOURS, days: tuple[int, ...] = DAYS) -> DataFrame:
    """(instance, symbol, t, value): the bar's range over the median range of so many bars before in its slot of the day."""
    ranges = bars.select("symbol", "t", (F.col("high") - F.col("low")).alias("volume"))
    found = None
    for n in days:
        rows = slot_medians(ranges, hours, n)
        value = F.when(F.abs("median") > TINY, F.col("volume") / F.col("median"))
        own = rows.select(F.lit(f"vol_deseason__days{n}").alias("instance"), "symbol", "t", value.alias("value"))
        found = own if found is None else found.unionByName(own)
    return found
