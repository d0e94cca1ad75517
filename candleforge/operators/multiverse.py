"""Paths that keep what bars are and lose their order: blocks of the common timeline change places, for all symbols alike.

A path cuts the timeline of all symbols into blocks, the first of them of a length that the path draws, and orders the
blocks by hashes of seed, path and block. Places are counted, never sorted as a whole: hashes are dealt into ranges,
blocks are placed inside these, and the few range sizes are added up. A symbol's bars take the places of their blocks,
so two symbols with gaps at different times still share the order; the bar that comes k-th gets the symbol's k-th time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candleforge.functions.stretches import LENGTH, numbered
from candleforge.operators.etl import timeline
from candleforge.operators.null_screen import running
from candleforge.sources.shared import Tables

#: Paths, seed, bars of a block.
PATHS, SEED, BLOCK = 1000, 42, 10
#: Blocks that are placed together, about.
TOGETHER = 1000


def hashed(*parts: Column) -> Column:
    """A number under 2**32 by the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def _prefixes(sizes: DataFrame, keys: list[str], part: str) -> DataFrame:
    """keys, part and _before: the sum of n over smaller parts."""
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy(part)) - F.col("n")
    return sizes.select(*keys, part, before.alias("_before"))


def block_order(paths: DataFrame, n: int, block: int, seed: int = SEED) -> DataFrame:
    """(path, blk, place) of each block of each path over a timeline of ``n`` bars."""
    # The draw of the first block's length, which may be none.
    rows = paths.withColumn("phase", hashed(F.lit(seed), F.col("path"), F.lit("phase")) % block)
    count = F.when(F.col("phase") > 0, 1).otherwise(0) + F.ceil((n - F.col("phase")) / block)
    rows = rows.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(1)) - 1)))
    rows = rows.withColumn("_h", hashed(F.lit(seed), F.col("path"), F.col("blk")))
    rows = rows.withColumn("_range", F.floor(F.col("_h") * max(1, n // block // TOGETHER) / 2**32))
    sizes = rows.groupBy("path", "_range").agg(F.count("*").alias("n"))
    inside = F.row_number().over(Window.partitionBy("path", "_range").orderBy("_h", "blk")) - 1
    placed = rows.withColumn("_inside", inside).join(_prefixes(sizes, ["path"], "_range"), ["path", "_range"])
    return placed.select("path", "phase", "blk", (F.col("_before") + F.col("_inside")).cast("long").alias("place"))


def joint_paths(bars: DataFrame, paths: int = PATHS, block: int = BLOCK, seed: int = SEED, length: int = LENGTH) -> DataFrame:
    """(path, symbol, t, open, high, low, close, volume, high_time, low_time) of paths 1 to ``paths``.

    A bar keeps its returns within itself and from the close before, and how long after its time its extremes come; the
    first close is the symbol's first open times the first return. Bars with a price that isn't above 0 are left out.
    """
    with Tables(bars.sparkSession) as tables:
        rows = tables.stored(numbered(bars.filter("open > 0 AND high > 0 AND low > 0 AND close > 0")).withColumn("_stretch", F.floor(F.col("_bar") / length)))
        times = tables.stored(timeline(rows))
        n = times.count()
        lasts = rows.groupBy("symbol", (F.col("_stretch") + 1).alias("_stretch")).agg(F.max_by("close", "_bar").alias("_last"))
        before = F.coalesce(F.lag("close").over(Window.partitionBy("symbol", "_stretch").orderBy("_bar")), "_last", "open")
        features = rows.join(lasts, ["symbol", "_stretch"], "left").withColumn("_pc", before).select(
            "symbol", "t", "_bar", "volume", F.ln(F.col("close") / F.col("_pc")).alias("rc"), F.ln(F.col("close") / F.col("open")).alias("ro"), F.ln(F.col("high") / F.col("open")).alias("rh"),
            F.ln(F.col("low") / F.col("open")).alias("rl"), (F.col("high_time") - F.col("t")).alias("after_high"), (F.col("low_time") - F.col("t")).alias("after_low"),
        )
        features = tables.stored(features.join(times, "t"))
        order = tables.stored(block_order(bars.sparkSession.range(1, paths + 1).withColumnRenamed("id", "path"), n, block, seed))
        # The block of a bar: what is before the phase is the first one, of length phase.
        phases = F.broadcast(order.select("path", "phase").distinct())
        first = F.when(F.col("phase") > 0, 1).otherwise(0)
        blk = F.when(F.col("position") < F.col("phase"), 0).otherwise(first + F.floor((F.col("position") - F.col("phase")) / block))
        of = features.crossJoin(phases).withColumn("blk", blk.cast("long")).join(order.select("path", "blk", "place"), ["path", "blk"])
        # Within a block a symbol's bars keep their order; blocks before it count as many bars as the symbol has there.
        sizes = of.groupBy("path", "symbol", "place").agg(F.count("*").alias("n"), F.min("_bar").alias("_first"))
        ranges = sizes.withColumn("_stretch", F.floor(F.col("place") / TOGETHER)).withColumnRenamed("place", "_bar")
        starts = running(ranges, F.col("n"), "_sum", ["path", "symbol"]).select("path", "symbol", F.col("_bar").alias("place"), "_first", (F.col("_sum") - F.col("n")).alias("_start"))
        moved = of.join(starts, ["path", "symbol", "place"]).withColumn("_to", (F.col("_start") + F.col("_bar") - F.col("_first")).cast("long"))
        moved = moved.select("path", "symbol", F.col("_to").alias("_bar"), "volume", "rc", "ro", "rh", "rl", "after_high", "after_low").withColumn("_stretch", F.floor(F.col("_bar") / length))
        opens = rows.filter("_bar = 0").select("symbol", F.col("open").alias("_start"))
        drawn = running(moved, F.col("rc"), "_sum", ["path", "symbol"]).join(F.broadcast(opens), "symbol").join(rows.select("symbol", "_bar", "t"), ["symbol", "_bar"])
        drawn = drawn.withColumn("close", F.col("_start") * F.exp("_sum")).withColumn("open", F.col("close") * F.exp(-F.col("ro")))
        out = drawn.select(
            "path", "symbol", "t", "open", (F.col("open") * F.exp("rh")).alias("high"), (F.col("open") * F.exp("rl")).alias("low"), "close", "volume",
            (F.col("t") + F.col("after_high")).alias("high_time"), (F.col("t") + F.col("after_low")).alias("low_time"),
        )
        return tables.kept(out)


def exact_mean(value: str) -> Column:
    """The mean of ``value`` by decimals of 12 places: equal results have equal means, however many and in any order."""
    return F.avg(F.col(value).cast("decimal(28,12)")).cast("double")


def permutation_pvalues(real: DataFrame, null: DataFrame, keys: list[str], paths: int) -> DataFrame:
    """keys, value and p: of ``real`` (keys, value) the share of paths, itself among them, that reach its value.

    ``null`` has path, keys and value; a path without a value doesn't reach any. Values that are the same reach each other,
    so they must not differ by the rounding of sums.
    """
    hits = null.withColumnRenamed("value", "_path").join(real, keys).filter("_path >= value").groupBy(*keys).agg(F.count("*").alias("hits"))
    return real.join(hits, keys, "left").select(*keys, "value", ((1 + F.coalesce("hits", F.lit(0))) / F.lit(1.0 + paths)).alias("p"))
