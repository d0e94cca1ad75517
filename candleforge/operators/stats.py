"""Resampling statistics over daily profits: bootstrap, reality check, step-down, permutation, deflated Sharpe."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.functions.arrow import lists

#: Fixed values.
REPLICAS, BLOCK, SEED = 1000, 10, 42
#: Numbers of a matrix of columns by days or replicas, of which a worker holds about ten.
TOGETHER = 1 << 19


@lru_cache(maxsize=2)
def bootstrap_weights(days: int, block: int = BLOCK, replicas: int = REPLICAS, seed: int = SEED) -> np.ndarray:
    """Times that each day is drawn in each replica by moving blocks; a row sums to ``days``."""
    rng = np.random.default_rng(seed)
    out = np.zeros((replicas, days), np.float64)
    per = -(-days // block)
    for r, starts in enumerate(rng.integers(0, max(days - block, 0) + 1, (replicas, per))):
        drawn = (starts[:, None] + np.arange(min(block, days))).ravel()[:days]
        out[r] = np.bincount(drawn, minlength=days)
    return out


def sharpe_deviations(
    daily: DataFrame, key: str, days: int, first: int, block: int = BLOCK, replicas: int = REPLICAS, weights: Callable[[int, int, int], np.ndarray] = bootstrap_weights
) -> DataFrame:
    """By column: its Sharpe, its z, and each replica's studentised deviation.

    A column becomes one row with its days, and a slice of a batch of columns one product with the weights, which a worker
    makes once from the seed; slices have ``TOGETHER`` numbers, so what a worker holds doesn't grow with the columns. A replica in which a column has no spread counts as minus infinity. Columns whose z is under
    -sqrt(2 ln ln days) get their z added to their deviations, so that poor columns don't raise the largest ones; those
    without any spread have z 0 and deviations of minus infinity.
    """

    def ratios(m: np.ndarray, q: np.ndarray) -> np.ndarray:
        var = q - m * m
        good = var > 1e-12
        return np.where(good, m / np.sqrt(np.where(good, var, 1.0) * days / (days - 1.0)), -np.inf)

    def studied(at: list[np.ndarray], profit: list[np.ndarray], w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.zeros((len(at), days))
        for i, (own_days, gains) in enumerate(zip(at, profit, strict=True)):
            x[i, own_days - first] = gains
        own = ratios(x.mean(axis=1), (x * x).mean(axis=1))
        with np.errstate(invalid="ignore"):
            dev = ratios(x @ w.T / days, (x * x) @ w.T / days) - own[:, None]
            finite = np.where(np.isfinite(dev), dev, np.nan)
            flat = ~np.isfinite(finite).any(axis=1)
            finite[flat] = 0.0
            spread = np.nanstd(finite, axis=1, ddof=1)
        flat |= ~(spread > 0)
        z = np.where(flat, 0.0, own / np.where(flat, 1.0, spread))
        out = np.where(flat[:, None] | np.isnan(dev), -np.inf, dev / np.where(flat, 1.0, spread)[:, None])
        out[z < -math.sqrt(2.0 * math.log(math.log(days)))] += z[z < -math.sqrt(2.0 * math.log(math.log(days))), None]
        return np.where(np.isfinite(own), own, 0.0), z, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, step = weights(days, block, replicas), max(1, TOGETHER // max(days, replicas))
        for batch in batches:
            for start in range(0, len(batch), step):
                rows = batch.slice(start, step)
                sharpe, z, out = studied(lists(rows.column("at")), lists(rows.column("profit")), w)
                deviation = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * replicas, out.ravel())
                yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(sharpe), pa.array(z), deviation], [key, "sharpe", "z", "deviation"])

    kind = daily.schema[key].dataType.simpleString()
    columns = daily.groupBy(key).agg(F.collect_list("idx").alias("at"), F.collect_list("profit").alias("profit"))
    return columns.mapInArrow(run, f"{key} {kind}, sharpe double, z double, deviation array<double>")


def reality_check(columns: DataFrame) -> DataFrame:
    """Share of replicas whose largest deviation reaches the best z."""
    # The best z is the same for every replica, so the columns are made once.
    tops = columns.select("z", F.posexplode("deviation").alias("replica", "d")).groupBy("replica").agg(F.max("d").alias("top"), F.max("z").alias("best"))
    return tops.agg(F.count("*").alias("replicas"), F.avg((F.col("top") >= F.col("best")).cast("double")).alias("p"))


def step_down(columns: DataFrame, key: str) -> DataFrame:
    """Step-down adjusted p of each column: the largest deviation among columns of no better z, with a running maximum.

    Suffix maxima by replica are a window over columns by z: one partition a replica, so replicas spread over tasks.
    """
    from pyspark.sql import Window

    long = columns.select(key, "z", F.posexplode("deviation").alias("replica", "d"))
    worse = Window.partitionBy("replica").orderBy("z", F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    p = long.withColumn("top", F.max("d").over(worse)).groupBy(key, "z").agg(F.avg((F.col("top") >= F.col("z")).cast("double")).alias("p"))
    # One row a column is left.
    better = Window.orderBy(F.desc("z"), key).rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("p", F.max("p").over(better))


def deflated_sharpe(sharpe: float, days: int, skew: float, kurtosis: float, trials: float, spread: float) -> float:
    """Probability that a Sharpe ratio beats the best expected of ``trials`` skill-less ones."""
    norm, gamma = NormalDist(), 0.5772156649015329
    best = spread * ((1 - gamma) * norm.inv_cdf(1 - 1 / trials) + gamma * norm.inv_cdf(1 - 1 / (trials * math.e))) if trials > 1 else 0.0
    return norm.cdf((sharpe - best) * math.sqrt(days - 1) / math.sqrt(max(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2, 1e-12)))
