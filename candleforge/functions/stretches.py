"""Long series cut in stretches, so that a window over a series isn't one task's work.

Rows are numbered by time without a window over the whole series: they are placed inside buckets of time, and the few
rows of bucket sizes are summed up. A stretch is a run of so many numbers; rows that windows of a neighbouring stretch
look back or ahead to are copied into it and dropped after the windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a stretch, and seconds of a bucket in which rows are placed.
LENGTH, BUCKET = 20_000, 30 * 86_400


def numbered(rows: DataFrame, key: str = "symbol", order: str = "t", name: str = "_bar") -> DataFrame:
    """``rows`` with their number from 0 by ``order`` (whole seconds, one row each) within ``key``."""
    bucket = F.floor(F.col(order) / BUCKET)
    sizes = rows.groupBy(key, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    before = sizes.select(key, "_bucket", (F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(order)) - 1
    placed = rows.withColumn("_bucket", bucket).withColumn("_place", place).join(before, [key, "_bucket"])
    return placed.select(*rows.columns, (F.col("_before") + F.col("_place")).cast("long").alias(name))


def stretched(rows: DataFrame, back: int = 0, ahead: int = 0, key: str = "symbol", order: str = "t", length: int | None = None) -> DataFrame:
    """``rows`` with ``_bar``, ``_stretch`` and ``_own``; ``back`` and ``ahead`` rows of the neighbours come as copies."""
    length = max(length or LENGTH, back, ahead)
    rows = numbered(rows, key, order)
    at, own = F.pmod("_bar", F.lit(length)), F.floor(F.col("_bar") / length)
    places = F.array(own, F.when(at >= length - back, own + 1), F.when(at < ahead, own - 1))
    return rows.withColumn("_stretch", F.explode(F.array_compact(places))).withColumn("_own", F.col("_stretch") == own)


def in_order(key: str = "symbol", order: str = "t") -> WindowSpec:
    """The rows of a stretch by time."""
    return Window.partitionBy(key, "_stretch").orderBy(order)
