"""Step-down tests that tolerate k false rejections, and the search for k by the share of false discoveries.

A test's columns stand in the order of their statistic, and what is needed of a replica's deviations is the k-th largest
among a suffix of that order. So each replica keeps its ``m`` largest deviations with their columns' places: partial
top-m lists of the tasks are merged by a ranked window of which Spark keeps the first m rows of each task before it
shuffles. A suffix of which a replica has too few in its list makes the lists grow, so no answer depends on m. A step of
the procedure then reads these lists and hands one number a replica to the driver. P-values are looked up in the steps'
critical values, a few thousand numbers, where the columns are.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candleforge.operators.walkforward import placed
from candleforge.sources.shared import Tables

#: Level of the test, share of false discoveries.
ALPHA, GAMMA = 0.10, 0.10

#: Of a step: its columns' first and last place less one, and the sorted critical values of the replicas.
Step = tuple[int, int, np.ndarray]


@lru_cache(maxsize=4)
def hash_weights(days: int, block: int, replicas: int, seed: int = 42) -> np.ndarray:
    """Times that each day is drawn in each replica by moving blocks whose starts are hashes of seed, replica and block.

    Any engine with MD5 can repeat them. The last block is cut so that a replica has as many days as the data.
    """
    block = min(block, days)
    per, out = -(-days // block), np.zeros((replicas, days))
    for r in range(replicas):
        starts = np.array([int(hashlib.md5(f"{seed}:{r}:{k}".encode()).hexdigest()[:8], 16) % (days - block + 1) for k in range(per)])
        out[r] = np.bincount((starts[:, None] + np.arange(block)).ravel()[:days], minlength=days)
    return out


class StepDown:
    """Step-down procedures over ``columns`` (key, z, deviation: an array with a number for each replica)."""

    def __init__(self, columns: DataFrame, key: str, tables: Tables, alpha: float = ALPHA, m: int = 1000):
        self.tables, self.key, self.alpha = tables, key, alpha
        rows = tables.stored(columns.select(key, "z", "deviation"))
        places = placed(rows.select(key, "z"), "z", key, "place")
        self.columns = tables.stored(places)
        self.long = tables.stored(rows.join(places.select(key, "place"), key).select("place", F.posexplode("deviation").alias("replica", "d")))
        self.n, self.replicas = self.columns.count(), self.long.select(F.max("replica")).first()[0]
        self.replicas = 0 if self.replicas is None else self.replicas + 1
        self.top: DataFrame | None = None
        self.m = 0
        self.grow(m)

    def grow(self, m: int) -> None:
        """Lists of the ``m`` largest deviations of each replica."""
        largest = F.row_number().over(Window.partitionBy("replica").orderBy(F.desc("d"), "place"))
        top = self.tables.stored(self.long.withColumn("at", largest).filter(F.col("at") <= m))
        if self.top is not None:
            self.tables.release(self.top)
        self.top, self.m = top, min(m, self.n)

    def critical(self, first: int, k: int) -> np.ndarray:
        """Each replica's k-th largest deviation among the columns after the first ``first``, sorted."""
        while True:
            nth = F.row_number().over(Window.partitionBy("replica").orderBy("at"))
            found = self.top.filter(F.col("place") > first).withColumn("nth", nth).filter(F.col("nth") == k).select("d").collect()
            if len(found) == self.replicas:
                return np.sort(np.array([r.d for r in found]))
            if self.m >= self.n:
                raise ValueError(f"columns have no {self.replicas} deviations each")
            self.grow(max(2 * self.m, first + k))

    def steps(self, k: int) -> list[Step]:
        """The steps at level k; each but the last rejects columns, so they end."""
        done, out = 0, []
        while done < self.n:
            first = done - min(done, k - 1)
            values = self.critical(first, min(k, self.n - first))
            spare = int(self.alpha * self.replicas + 1e-9)
            # A column is rejected if no more than the spare replicas reach its statistic.
            cut = values[self.replicas - 1 - spare] if spare < self.replicas else -math.inf
            rejected = self.columns.filter(F.col("z") > float(cut)).count()
            out.append((done, rejected if rejected > done else self.n, values))
            if rejected <= done:
                break
            done = rejected
        return out

    def rejected(self, steps: list[Step]) -> int:
        """Columns rejected: all of the steps before the last, which rejects none unless it ends the columns."""
        spare = int(self.alpha * self.replicas + 1e-9)
        if not steps:
            return 0
        begin, end, values = steps[-1]
        cut = values[self.replicas - 1 - spare] if spare < self.replicas else -math.inf
        return begin + self.columns.filter((F.col("place") > begin) & (F.col("z") > float(cut))).count()

    def pvalues(self, steps: list[Step]) -> DataFrame:
        """key, z, place and p: the share of replicas that reach z in the column's step, with a running maximum."""
        ends = [end for _, end, _ in steps]
        last = {r.place: r.z for r in self.columns.filter(F.col("place").isin(ends)).collect()}
        share = lambda z, values: (len(values) - np.searchsorted(values, z)) / max(len(values), 1)
        least = np.maximum.accumulate([0.0, *[float(share(last[end], values)) for _, end, values in steps]]).tolist()

        def run(batches):
            for batch in batches:
                place, z = batch.column("place").to_numpy(), batch.column("z").to_numpy()
                of = np.searchsorted(ends, place)
                p = np.zeros(len(place))
                for i in np.unique(of):
                    own = of == i
                    p[own] = np.maximum(share(z[own], steps[i][2]), least[i])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "p"])

        rows = self.columns.select(self.key, "z", "place")
        return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", p double")

    def by_false_discoveries(self, gamma: float = GAMMA) -> tuple[int, list[Step]]:
        """The least k whose procedure rejects fewer than k / gamma - 1 columns, and its steps.

        A higher k never rejects fewer columns, so no k is passed over that could do where the last one rejected as many
        as its share allows or more: the next one tried is the least that allows more than the last one rejected. There
        are n columns at most to reject, so a k always does.
        """
        k = 1
        while True:
            steps = self.steps(k)
            rejected = self.rejected(steps)
            if rejected < k / gamma - 1.0:
                return k, steps
            k = max(k + 1, math.floor(gamma * (rejected + 1.0)))
            while rejected >= k / gamma - 1.0:
                k += 1


def step_down_pvalues(columns: DataFrame, key: str, k: int = 1, alpha: float = ALPHA, m: int = 1000) -> DataFrame:
    """key, z, place and adjusted p of each column where k - 1 false rejections are tolerated."""
    with Tables(columns.sparkSession) as tables:
        test = StepDown(columns, key, tables, alpha, m)
        return tables.kept(test.pvalues(test.steps(k)))


def false_discovery_pvalues(columns: DataFrame, key: str, gamma: float = GAMMA, alpha: float = ALPHA, m: int = 1000) -> DataFrame:
    """key, z, place, p and k: adjusted p at the k that keeps the share of false discoveries under ``gamma``."""
    with Tables(columns.sparkSession) as tables:
        test = StepDown(columns, key, tables, alpha, m)
        k, steps = test.by_false_discoveries(gamma)
        return tables.kept(test.pvalues(steps).withColumn("k", F.lit(k)))


#: Percentiles of the columns that are compared with those of the replicas. Fixed values.
PERCENTILES = (1, 2, 3, 4, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 96, 97, 98, 99)


def percentile_bootstrap(columns: DataFrame, key: str, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """percentile, real (of the columns' z), simulated (the replicas' mean) and below (the percentage of replicas under real).

    A replica's percentile lies between two of its ordered deviations, which are picked by their places in its list.
    """
    spark = columns.sparkSession
    with Tables(spark) as tables:
        test = StepDown(columns, key, tables, m=1)
        if not test.n:
            return spark.createDataFrame([], "percentile double, real double, simulated double, below double")
        # Places from 1 of the largest, with what the higher of the two weighs.
        rows = [(float(p), test.n - int(at), at - int(at)) for p in percentiles for at in [p / 100.0 * (test.n - 1)]]
        test.grow(max(place for _, place, _ in rows))
        places = F.broadcast(spark.createDataFrame(rows, "percentile double, low long, weight double"))

        def between(values: DataFrame, at: str, value: str, keys: list[str]) -> DataFrame:
            met = values.join(places, (F.col(at) == F.col("low")) | (F.col(at) == F.col("low") - 1))
            share = F.when(F.col(at) == F.col("low"), 1 - F.col("weight")).otherwise(F.col("weight"))
            # A weight of 0 leaves out what may be minus infinity.
            return met.groupBy("percentile", *keys).agg(F.sum(F.when(share > 0, share * F.col(value)).otherwise(0.0)).alias("x"))

        real = between(test.columns, "place", "z", []).withColumnRenamed("x", "real")
        null = between(test.top, "at", "d", ["replica"]).join(F.broadcast(real), "percentile")
        out = null.groupBy("percentile").agg(F.first("real").alias("real"), F.avg("x").alias("simulated"), (100.0 * F.avg((F.col("x") < F.col("real")).cast("double"))).alias("below"))
        return tables.kept(out)


def best_of_each(pvalues: DataFrame, rule: str, combo: str, alpha: float = ALPHA) -> DataFrame:
    """By rule its column of least p, of equals the one of largest z, and whether it passes."""
    best = F.min_by(F.struct(combo, "z", "p"), F.struct("p", -F.col("z"), combo))
    return pvalues.groupBy(rule).agg(best.alias("x")).select(rule, f"x.{combo}", "x.z", "x.p", (F.col("x.p") <= alpha).alias("passed"))
