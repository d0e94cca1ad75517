"""Edges of indicator segments against the whole, and of pairs of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(value: Column, cuts: list[float]) -> Column:
    """Twice the number of cuts below a value, plus one if it equals the next; null without a value."""
    out = F.lit(0).cast("long")
    for c in cuts:
        out = out + F.when(value > c, 2).when(value == c, 1).otherwise(0)
    return F.when(value.isNotNull(), out)


def segment_edges(rows: DataFrame, cuts: list[float], least: int = 30) -> DataFrame:
    """For each cut, below and above: size, mean, excess over all and its z. ``rows`` has value and y.

    One aggregation to bins, of which there are a few; cumulative sums over bins give each segment.
    """
    bins = rows.select(bin_of(F.col("value"), cuts).alias("bin"), "y").filter("bin IS NOT NULL AND y IS NOT NULL")
    sums = bins.groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    sides = sums.select("*", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("cut"), F.lit(side).alias("side")) for i in range(len(cuts)) for side in ("<", ">")])).alias("g"))
    inside = F.when(F.col("g.side") == "<", F.col("bin") < 2 * F.col("g.cut") + 1).otherwise(F.col("bin") > 2 * F.col("g.cut") + 1)
    total = lambda c: F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(c)
    out = sides.groupBy("g.cut", "g.side").agg(total("n"), total("s"), total("q"), F.sum("n").alias("an"), F.sum("s").alias("as_"), F.sum("q").alias("aq"))
    mean, every = F.col("s") / F.col("n"), F.col("as_") / F.col("an")
    sd = lambda q, m, n: F.sqrt(F.greatest(F.col(q) / F.col(n) - m * m, F.lit(0.0)))
    spread = F.greatest(sd("q", mean, "n"), sd("aq", every, "an"))
    z = F.when(spread > 0, (mean - every) / (spread / F.sqrt(F.col("n"))))
    return out.filter((F.col("n") >= least) & (F.col("an") - F.col("n") >= least)).select("cut", "side", "n", mean.alias("mean"), (mean - every).alias("excess"), z.alias("z"))


def pair_table(rows: DataFrame, cuts_a: list[float], cuts_b: list[float]) -> DataFrame:
    """Sizes and sums of all rectangles [0..i] x [0..j] of two binned values, from a histogram and two cumulative windows."""
    cells = rows.select(bin_of(F.col("a"), cuts_a).alias("i"), bin_of(F.col("b"), cuts_b).alias("j"), "y").filter("i IS NOT NULL AND j IS NOT NULL AND y IS NOT NULL")
    cells = cells.groupBy("i", "j").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    # Every cell of the small grid, so that cumulative sums have no holes.
    grid = rows.sparkSession.range(2 * len(cuts_a) + 1).withColumnRenamed("id", "i").crossJoin(rows.sparkSession.range(2 * len(cuts_b) + 1).withColumnRenamed("id", "j"))
    full = grid.join(cells, ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0.0)).alias("s"))
    up_to = lambda key, order: Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    along = full.withColumns({"n": F.sum("n").over(up_to("i", "j")), "s": F.sum("s").over(up_to("i", "j"))})
    return along.select("i", "j", F.sum("n").over(up_to("j", "i")).alias("n"), F.sum("s").over(up_to("j", "i")).alias("s"))
