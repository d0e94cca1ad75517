"""Cleaning, integrity and alignment of candle tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candleforge.functions.stretches import BUCKET, in_order, stretched

PRICES = ("open", "high", "low", "close")


def to_number(column: str) -> Column:
    """A text as a double; what isn't one is missing."""
    return F.expr(f"try_cast({column} AS DOUBLE)")


def drop_bad_prices(bars: DataFrame) -> DataFrame:
    """Rows whose four prices are all there and not zero."""
    good = F.lit(True)
    for c in PRICES:
        good &= F.coalesce(F.col(c) != 0, F.lit(False))
    return bars.filter(good)


def fill_volume(bars: DataFrame) -> DataFrame:
    """Zero volumes count as missing; the last one known is carried on, the first one back to the start, else 0.

    In two steps: inside buckets of time, and from bucket to bucket over a table with one row each.
    """
    known = F.when(F.col("volume") != 0, F.col("volume"))
    bucket = F.floor(F.col("t") / BUCKET)
    ends = bars.groupBy("symbol", bucket.alias("_bucket")).agg(F.max_by(known, F.when(known.isNotNull(), F.col("t"))).alias("_last"), F.min_by(known, F.when(known.isNotNull(), F.col("t"))).alias("_first"))
    by = Window.partitionBy("symbol").orderBy("_bucket")
    carried = ends.select("symbol", "_bucket", F.last("_last", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(by.rowsBetween(0, Window.unboundedFollowing)).alias("_after"))
    rows = bars.withColumn("_bucket", bucket).join(carried, ["symbol", "_bucket"])
    inside = Window.partitionBy("symbol", "_bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(known, ignorenulls=True).over(inside), "_before", "_after", F.lit(0.0))
    return rows.withColumn("volume", filled).select(*bars.columns)


def first_of_each_time(bars: DataFrame, arrival: str) -> DataFrame:
    """One row for each symbol and time, the first to arrive; an aggregation, so no row order is relied on."""
    rest = [c for c in bars.columns if c not in ("symbol", "t", arrival)]
    kept = bars.groupBy("symbol", "t").agg(F.min_by(F.struct(*rest), arrival).alias("_row"))
    return kept.select("symbol", "t", *[F.col(f"_row.{c}").alias(c) for c in rest])


def intrabar_extremes(high_bars: DataFrame, low_bars: DataFrame, seconds: int) -> DataFrame:
    """``high_bars`` with the time of the first highest and the first lowest of the finer bars inside each.

    On a regular grid the enclosing bar is known from the time alone, so this is an equi-join of an aggregation rather
    than a range join. A symbol's last bar is dropped, as are bars before its first finer one; empty ones get nulls.
    """
    inside = low_bars.withColumn("bar", F.floor(F.col("t") / seconds).cast("long") * seconds)
    found = inside.groupBy("symbol", "bar").agg(
        F.max_by("t", F.struct("high", -F.col("t"))).alias("high_time"), F.min_by("t", F.struct("low", "t")).alias("low_time")
    )
    span = low_bars.groupBy("symbol").agg(F.min("t").alias("_first"))
    last = high_bars.groupBy("symbol").agg(F.max("t").alias("_last"))
    rows = high_bars.join(span, "symbol").join(last, "symbol").filter("t < _last AND t >= _first").drop("_first", "_last")
    return rows.join(found.withColumnRenamed("bar", "t"), ["symbol", "t"], "left")


def gaps(bars: DataFrame, seconds: int, forex: bool = False) -> DataFrame:
    """Pairs of neighbouring bars more than 1.5 steps apart; for ``forex`` not those over a weekend."""
    rows = stretched(bars.select("symbol", "t"), back=1).withColumn("gap_from", F.lag("t").over(in_order())).filter("_own")
    out = rows.select("symbol", "gap_from", F.col("t").alias("gap_to")).withColumn("missing", F.floor((F.col("gap_to") - F.col("gap_from")) / seconds).cast("long") - 1)
    out = out.filter(F.col("gap_to") - F.col("gap_from") > 1.5 * seconds)
    if forex:
        weekend = (weekday(F.col("gap_from")) == 4) & weekday(F.col("gap_to")).isin(5, 6, 0)
        out = out.filter(~weekend)
    return out


def weekday(seconds: Column) -> Column:
    """Monday is 0; the epoch was a Thursday."""
    return F.pmod(F.floor(seconds / 86_400).cast("long") + 3, F.lit(7))


def ohlc_integrity(bars: DataFrame) -> DataFrame:
    """Counts of faults by symbol, in one pass."""
    zero = F.lit(False)
    for c in PRICES:
        zero |= F.coalesce(F.col(c) == 0, F.lit(False))
    low_fault = (F.col("low") > F.col("open")) | (F.col("low") > F.col("close"))
    high_fault = (F.col("high") < F.col("open")) | (F.col("high") < F.col("close"))
    return bars.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in (*PRICES, "volume")],
        F.count_if(zero).alias("zero_price"), F.count_if(F.col("volume") == 0).alias("zero_volume"), F.count_if(low_fault | high_fault).alias("incoherent"),
    )


def coverage(frames: dict[str, DataFrame], most_days: int = 5) -> DataFrame:
    """By symbol and timeframe: span, and whether it starts or ends more than ``most_days`` from the daily one."""
    spans = None
    for name, bars in frames.items():
        own = bars.groupBy("symbol").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t")).withColumn("timeframe", F.lit(name))
        spans = own if spans is None else spans.unionByName(own)
    daily = spans.filter("timeframe = '1D'").select("symbol", F.col("first_t").alias("d0"), F.col("last_t").alias("d1"))
    most = most_days * 86_400
    return spans.join(daily, "symbol").select(
        "symbol", "timeframe", "first_t", "last_t", (F.col("first_t") - F.col("d0") > most).alias("late_start"),
        (F.abs(F.col("last_t") - F.col("d1")) > most).alias("end_differs"),
    )


def split_in_out(bars: DataFrame, start: str, reference: str, months: int) -> DataFrame:
    """``sample``: IS before the last ``months`` calendar months up to ``reference``, OOS inside them; later rows go."""
    cut = F.unix_date(F.add_months(F.lit(reference).cast("date"), -months)).cast("long") * 86_400
    end, begin = (F.unix_date(F.lit(d).cast("date")).cast("long") * 86_400 for d in (reference, start))
    rows = bars.filter((F.col("t") >= begin) & (F.col("t") < end))
    return rows.withColumn("sample", F.when(F.col("t") < cut, "IS").otherwise("OOS"))


def long_histories(bars: DataFrame, daily: DataFrame, least: int) -> DataFrame:
    """Bars of symbols with at least ``least`` daily bars."""
    return bars.join(daily.groupBy("symbol").count().filter(F.col("count") >= least).select("symbol"), "symbol", "left_semi")


def rebuild(bars: DataFrame, fine: int, seconds: int, offset: int = 0) -> DataFrame:
    """Coarser bars from complete sets of finer ones."""
    start = F.floor((F.col("t") - offset) / seconds).cast("long") * seconds + offset
    return (
        bars.withColumn("bar", start)
        .groupBy("symbol", "bar")
        .agg(F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"), F.count("*").alias("n"))
        .filter(F.col("n") == seconds // fine)
        .drop("n")
        .withColumnRenamed("bar", "t")
    )


def compare_bars(own: DataFrame, rebuilt: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Status of each native bar against the rebuilt one: NO_1H, FLAT, OK or DIFF, with the largest relative difference."""
    b = rebuilt.select("symbol", "t", *[F.col(c).alias(f"b_{c}") for c in PRICES])
    both = own.join(b, ["symbol", "t"], "left")
    worst = F.greatest(*[F.abs(F.col(c) - F.col(f"b_{c}")) / F.when(F.col(c) != 0, F.abs(F.col(c))) for c in PRICES])
    status = F.when(F.col("b_open").isNull(), "NO_1H").when(F.col("high") == F.col("low"), "FLAT").when(worst <= tolerance, "OK").otherwise("DIFF")
    return both.select("symbol", "t", status.alias("status"), worst.alias("worst"))


def common_times(bars: DataFrame) -> DataFrame:
    """Times at which every symbol has a bar."""
    n = bars.agg(F.countDistinct("symbol").alias("n"))
    return bars.groupBy("t").agg(F.countDistinct("symbol").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("t")


def timeline(bars: DataFrame) -> DataFrame:
    """All distinct times with their position, numbered without one global window: ranges are sorted, sized and offset."""
    times = bars.select("t").distinct()
    day = F.floor(F.col("t") / 86_400)
    sizes = times.groupBy(day.alias("day")).count()
    # One row a day: small enough for one window.
    before = sizes.select("day", (F.sum("count").over(Window.orderBy("day")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("t")) - 1
    return times.withColumn("day", day).withColumn("place", place).join(before, "day").select("t", (F.col("before") + F.col("place")).alias("position"))


def top_by_volume(bars: DataFrame, last: int, n: int) -> DataFrame:
    """The n symbols of the largest mean quote volume over their last bars."""
    recent = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("t")))
    means = bars.withColumn("_r", recent).filter(F.col("_r") <= last).groupBy("symbol").agg(F.avg(F.col("volume") * F.col("close")).alias("mean_volume"))
    return means.orderBy(F.desc("mean_volume"), "symbol").limit(n)


def price_decimals(bars: DataFrame, most: int = 8) -> DataFrame:
    """By symbol the least number of decimals at which all closes are whole."""
    d = F.explode(F.sequence(F.lit(0), F.lit(most))).alias("d")
    scaled = F.col("close") * F.pow(F.lit(10.0), F.col("d"))
    fits = F.bool_and(F.abs(scaled - F.rint(scaled)) < 1e-6 * F.greatest(F.lit(1.0), F.abs(scaled)))
    return bars.select("symbol", "close", d).groupBy("symbol", "d").agg(fits.alias("fits")).filter("fits").groupBy("symbol").agg(F.min("d").cast("long").alias("decimals"))


def density(bars: DataFrame, per_day: float, least: float = 0.9) -> DataFrame:
    """By symbol and 10-day stretch, first and last left out: bars against those expected."""
    stretch = F.floor(F.col("t") / 864_000).cast("long")
    counts = bars.groupBy("symbol", stretch.alias("stretch")).count()
    w = Window.partitionBy("symbol")
    inner = counts.withColumns({"_a": F.min("stretch").over(w), "_b": F.max("stretch").over(w)}).filter("stretch > _a AND stretch < _b")
    return inner.select("symbol", "stretch", F.col("count").alias("n"), (F.col("count") < least * per_day * 10).alias("sparse"))


def deals_to_trades(deals: DataFrame) -> DataFrame:
    """Positions from in and out deals: open time, close time, profit, and OPEN without an out deal."""
    is_in, is_out = F.col("entry") == "in", F.col("entry") == "out"
    rows = deals.groupBy("position_id").agg(
        F.min(F.when(is_in, F.col("us"))).alias("open_us"), F.max(F.when(is_out, F.col("us"))).alias("close_us"), F.sum(F.when(is_out, F.col("profit")).otherwise(0.0)).alias("profit")
    )
    return rows.filter("open_us IS NOT NULL").withColumn("status", F.when(F.col("close_us").isNull(), "OPEN").otherwise("CLOSED"))
