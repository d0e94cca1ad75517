"""Recursions along a series without a task that holds the whole of it.

Steps that compose are folded inside stretches of rows, and the stretches' results are composed by doubling: after round
i a stretch knows the composition of the 2**i stretches that end with it, or a place the one it reaches by 2**i jumps. A
series of a billion rows in stretches of 20,000 takes 16 rounds over 50,000 rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candleforge.functions.stretches import LENGTH, numbered
from candleforge.sources.shared import Tables

#: Entries of a stretch in a walk.
WALK = 4096


def _composed(ends: DataFrame, tables: Tables) -> DataFrame:
    """key, stretch and the composition (a, b) of all maps y -> a y + b up to and with the stretch's."""
    now, step = tables.stored(ends), 1
    last = now.agg(F.max("stretch")).first()[0] or 0
    while step <= last:
        before = now.select("key", (F.col("stretch") + step).alias("stretch"), F.col("a").alias("pa"), F.col("b").alias("pb"))
        joined = now.join(before, ["key", "stretch"], "left")
        after = tables.stored(joined.select("key", "stretch", (F.col("a") * F.coalesce("pa", F.lit(1.0))).alias("a"), (F.col("b") + F.col("a") * F.coalesce("pb", F.lit(0.0))).alias("b")))
        tables.release(now)
        now, step = after, 2 * step
    return now


def affine_scan(rows: DataFrame, a: Column, b: Column, name: str, key: str = "symbol", order: str = "t", length: int = LENGTH) -> DataFrame:
    """``rows`` with ``name``: y = a * y of the row before + b, by ``order`` within ``key``, from y = 0 before the first.

    A row with a = 0 starts anew. Null coefficients count as a = 1 and b = 0: y stays as it is.
    """
    tables = Tables(rows.sparkSession)
    with tables:
        one = numbered(rows, key, order).withColumns({"_a": F.coalesce(a.cast("double"), F.lit(1.0)), "_b": F.coalesce(b.cast("double"), F.lit(0.0))})
        one = one.withColumn("_stretch", F.floor(F.col("_bar") / length))

        def fold(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("_bar")
            total, factor, product, sums = 0.0, 1.0, [], []
            for x, y in zip(part["_a"].to_numpy().tolist(), part["_b"].to_numpy().tolist(), strict=True):
                total, factor = x * total + y, x * factor
                sums.append(total)
                product.append(factor)
            return part.assign(_a=product, _b=sums)

        local = tables.kept(one.groupBy(key, "_stretch").applyInPandas(fold, one.schema))
        at_end = F.max_by(F.struct("_a", "_b"), "_bar").alias("x")
        ends = local.groupBy(F.col(key).alias("key"), F.col("_stretch").alias("stretch")).agg(at_end).select("key", "stretch", F.col("x._a").alias("a"), F.col("x._b").alias("b"))
        carried = tables.kept(_composed(ends, tables).select(F.col("key").alias(key), (F.col("stretch") + 1).alias("_stretch"), F.col("b").alias("_carry")))
        out = local.join(carried, [key, "_stretch"], "left").withColumn(name, F.col("_b") + F.col("_a") * F.coalesce("_carry", F.lit(0.0)))
        return out.select(*rows.columns, name)


def walk_totals(rows: DataFrame, key: str = "symbol", at: str = "bar", exit_at: str = "exit_bar", y: str = "y", length: int = WALK) -> DataFrame:
    """By key the sum and number of results ``y`` that are taken if an entry waits until after the last one's exit.

    ``rows`` has at most one entry a place; an exit isn't before its entry. Each stretch is walked from each place at which
    it can be entered, which are as many as the longest result takes; the stretches' walks are joined by doubling.
    """
    with Tables(rows.sparkSession) as tables:
        own = rows.select(F.col(key).alias("key"), F.col(at).alias("at"), (F.col(exit_at) + 1).alias("free"), F.col(y).cast("double").alias("y"))
        own = tables.stored(own.withColumn("stretch", F.floor(F.col("at") / length)))
        reach = own.agg(F.max(F.col("free") - F.col("at"))).first()[0]
        # Stretches without entries are passed through.
        spans = own.groupBy("key").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high"))
        spine = spans.select("key", F.explode(F.sequence("low", "high")).alias("stretch"))
        every = own.unionByName(spine, allowMissingColumns=True)

        def walked(name: tuple, part: pd.DataFrame) -> pd.DataFrame:
            begin, end = int(name[1]) * length, (int(name[1]) + 1) * length
            found = part[part["at"].notna()].sort_values("at")
            places, free, gain = found["at"].to_numpy(np.int64), found["free"].to_numpy(np.int64), found["y"].to_numpy()
            n = len(places)
            after = np.searchsorted(places, free)
            out, total, count = np.full(n + 1, end, np.int64), np.zeros(n + 1), np.zeros(n + 1, np.int64)
            for i in range(n - 1, -1, -1):
                j = after[i]
                out[i], total[i], count[i] = (max(free[i], end), gain[i], 1) if j == n else (out[j], gain[i] + total[j], 1 + count[j])
            entered = np.arange(begin, begin + min(length, max(int(reach), 1)))
            first = np.searchsorted(places, entered)
            return pd.DataFrame({"key": name[0], "at": entered, "out": out[first], "total": total[first], "n": count[first]})

        kind = own.schema["key"].dataType.simpleString()
        now = tables.stored(every.groupBy("key", "stretch").applyInPandas(walked, f"key {kind}, at long, out long, total double, n long"))
        ends = tables.stored(spans.select("key", (F.col("low") * length).alias("first"), ((F.col("high") + 1) * length).alias("end")))
        while not now.join(ends, "key").filter("out < end").isEmpty():
            then = now.select("key", F.col("at").alias("out"), F.col("out").alias("out2"), F.col("total").alias("total2"), F.col("n").alias("n2"))
            joined = now.join(then, ["key", "out"], "left")
            jumped = joined.select("key", "at", F.coalesce("out2", "out").alias("out"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))
            after = tables.stored(jumped)
            tables.release(now)
            now = after
        done = now.join(ends.withColumnRenamed("first", "at"), ["key", "at"])
        return tables.kept(done.select(F.col("key").alias(key), "total", "n"))


def wilder(rows: DataFrame, x: Column, n: int, name: str, key: str = "symbol", order: str = "t", length: int = LENGTH) -> DataFrame:
    """``rows`` with Wilder's mean of ``x``: the mean of the first ``n`` values that aren't null, then (n - 1) / n of the mean
    before plus x / n; null before it begins, unchanged where ``x`` is null later."""
    valued = rows.withColumn("_x", x.cast("double"))
    nth = numbered(valued.filter("_x IS NOT NULL"), key, order, "_nth").select(key, order, "_x", "_nth")
    # A row a key, of its first n values.
    seeds = nth.filter(F.col("_nth") < n).groupBy(key).agg(F.avg("_x").alias("_seed"), F.max(order).alias("_begin"), F.count("*").alias("_m")).filter(F.col("_m") == n)
    joined = valued.join(nth.drop("_x"), [key, order], "left").join(seeds.drop("_m"), key, "left")
    starts, goes = F.col(order) == F.col("_begin"), F.col("_nth") >= n
    a = F.when(starts, 0.0).when(goes, (n - 1.0) / n)
    b = F.when(starts, F.col("_seed")).when(goes, F.col("_x") / n)
    out = affine_scan(joined, a, b, name, key, order, length)
    return out.withColumn(name, F.when(F.col(order) >= F.col("_begin"), F.col(name))).select(*rows.columns, name)
