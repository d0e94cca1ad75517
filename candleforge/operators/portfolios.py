"""Portfolios of a short list of strategies: sets under side and timeframe rules, scored by subperiod and ranked.

Sets grow by one strategy a level, and a set that can no longer meet the rules in the places that it has left is dropped
at once, so none is listed in vain. Sets are numbers with a bit for each member. Scores of a subperiod come from products
of the sets' members with the daily profits, which have a row for each of at most ``MOST`` strategies and day and are
sent to the tasks. Ranks use no window over all sets.

Defined results: subperiods without any trade don't count; a set without trades in a subperiod, or that doesn't gain in
it, has no score there and takes the worst rank; equal scores are ranked by the set's number.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candleforge.sources.shared import Tables

#: Mean days of a month and the capital of a strategy. Fixed values.
DAYS_A_MONTH, CAPITAL = 30.4368, 1000.0
#: Strategies that a number has bits for, sets that are scored at once, ranges of scores.
MOST, STEP, PARTS = 62, 512, 200
METRICS = ("net_gain", "max_drawdown", "r2", "calmar")
_EPOCH = date(1970, 1, 1)


def months_before(day: int, months: int) -> int:
    """The epoch day so many calendar months earlier; the last of a month that is too short."""
    at = _EPOCH + timedelta(days=day)
    year, month = divmod(at.year * 12 + at.month - 1 - months, 12)
    return (date(year, month + 1, min(at.day, calendar.monthrange(year, month + 1)[1])) - _EPOCH).days


def subperiods(first: int, last: int, months: int) -> list[tuple[int, int]]:
    """(from, to) epoch days, both inclusive, oldest first: steps of calendar months back from the last day; a rest shorter
    than a step stays with the oldest."""
    cuts, at = [last], last
    while (before := months_before(at, months)) - first >= months * DAYS_A_MONTH:
        cuts.append(before)
        at = before
    cuts = [*cuts, first][::-1]
    return [(a, b if i == len(cuts) - 2 else b - 1) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def weights(n: int) -> list[float]:
    """Equal weights, but the last subperiod counts double and the others give way to it."""
    return [1.0] if n == 1 else [round((1 - 2 / n) / (n - 1), 6)] * (n - 1) + [round(2 / n, 6)]


def numbered_ids(ids: DataFrame) -> DataFrame:
    """``ids`` (id, grp) with idx by id from 0, the bit of its group, and the bits of the groups that come later."""
    if ids.count() > MOST:
        raise ValueError(f"a set's number has bits for {MOST} strategies")
    every, after = Window.orderBy("id"), Window.orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    rows = ids.withColumn("idx", (F.row_number().over(every) - 1).cast("int"))
    rows = rows.withColumn("bit", F.expr("shiftleft(1L, CAST(dense_rank() OVER (ORDER BY grp) - 1 AS INT))"))
    return rows.withColumn("later", F.coalesce(F.bit_or("bit").over(after), F.lit(0).cast("long")))


def covering_sets(ids: DataFrame, least: int, most: int) -> DataFrame:
    """(combo, size) of the sets of ``least`` to ``most`` strategies with one of each group at least.

    With timeframe and side as the group, a set has both sides of every timeframe that has both; with the timeframe alone,
    every timeframe; with one group for all there is no rule.
    """
    own = F.broadcast(ids.select("idx", F.expr("shiftleft(1L, idx)").alias("one"), "bit", "later"))
    need = ids.agg(F.coalesce(F.bit_or("bit"), F.lit(0).cast("long"))).first()[0]
    with Tables(ids.sparkSession) as tables:
        level = ids.sparkSession.range(1).select(F.lit(0).cast("long").alias("combo"), F.lit(-1).alias("last"), F.lit(need).cast("long").alias("missing"))
        found = []
        for size in range(1, most + 1):
            # At most MOST strategies: each set is extended by those after its last one.
            grown = level.join(own, F.col("idx") > F.col("last"))
            missing = F.expr("missing & ~bit")
            grown = grown.select((F.col("combo") + F.col("one")).alias("combo"), F.col("idx").alias("last"), missing.alias("missing"), "later")
            hopeful = (F.bit_count("missing") <= most - size) & (F.expr("missing & ~later") == 0)
            level = tables.stored(grown.filter(hopeful).drop("later"))
            if size >= least:
                found.append(level.filter("missing = 0").select("combo", F.lit(size).cast("long").alias("size")))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return tables.kept(out)


def _measured(members: np.ndarray, profits: np.ndarray, capital: float) -> dict[str, np.ndarray]:
    """The metrics of sets (members, 0 or 1 by set and strategy) over the days of a subperiod."""
    members = members * profits.any(axis=1)
    n = members.sum(axis=1)
    gains = members @ profits
    base = np.where(n > 0, capital * n, np.nan)
    equity = base[:, None] + np.cumsum(gains, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        peak = np.maximum.accumulate(equity, axis=1)
        fall = ((equity - peak) / peak * 100).min(axis=1)
        gain = (equity[:, -1] - base) / base * 100
        # The fit's line runs from the first to the last day with a profit or loss.
        moved = gains != 0
        inside = np.maximum.accumulate(moved, axis=1) & np.maximum.accumulate(moved[:, ::-1], axis=1)[:, ::-1]
        count, x = inside.sum(axis=1), np.arange(gains.shape[1], dtype=float)
        dx = (x - (inside @ x / count)[:, None]) * inside
        dy = (equity - ((equity * inside).sum(axis=1) / count)[:, None]) * inside
        spread = (dx**2).sum(axis=1) * (dy**2).sum(axis=1)
        r2 = np.where(spread > 0, (dx * dy).sum(axis=1) ** 2 / spread, np.nan)
        return {"net_gain": gain, "max_drawdown": -np.abs(fall), "r2": r2, "calmar": np.where(fall < 0, gain / np.abs(fall), np.nan)}


def scored(sets: DataFrame, daily: DataFrame, spans: list[tuple[int, int]], metric: str = "r2", capital: float = CAPITAL) -> DataFrame:
    """``sets`` with a score for each subperiod (s0, s1, ...), null where a set doesn't gain or has no trades.

    ``daily`` has idx, day and profit; its rows are at most MOST a day, so its size is bounded by the calendar.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}")
    cells = daily.groupBy("idx", "day").agg(F.sum("profit").alias("profit")).toPandas()
    tables = []
    for begin, end in spans:
        own = cells[(cells["day"] >= begin) & (cells["day"] <= end)]
        if len(own):
            start = own["day"].min()
            table = np.zeros((MOST, own["day"].max() - start + 1))
            table[own["idx"], own["day"] - start] = own["profit"]
            tables.append(table)
    shared = sets.sparkSession.sparkContext.broadcast(tables)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), STEP):
                rows = batch.slice(at, STEP)
                combos = rows.column("combo").to_numpy()
                members = ((combos[:, None] >> np.arange(MOST)) & 1).astype(float)
                columns = []
                for table in shared.value:
                    found = _measured(members, table, capital)
                    value = np.where(found["net_gain"] > 0, found[metric], np.nan)
                    columns.append(pa.array(np.round(value, 3), from_pandas=True))
                yield pa.RecordBatch.from_arrays([rows.column("combo"), rows.column("size"), *columns], ["combo", "size", *names])

    names = [f"s{i}" for i in range(len(tables))]
    return sets.select("combo", "size").mapInArrow(score, "combo long, size long" + "".join(f", {n} double" for n in names))


def ranked(scores: DataFrame, positive: bool = False, parts: int = PARTS) -> DataFrame:
    """``scores`` with r0, r1, ... and weighted_rank, the mean of ranks by the weights of the subperiods, less is better.

    With ``positive`` only sets with a score in every subperiod take part. Quantiles cut the scores of each subperiod to
    ranges, sets are placed inside these, and sizes of ranges are summed up: all subperiods in one pass.
    """
    names = [c for c in scores.columns if c.startswith("s") and c[1:].isdigit()]
    with Tables(scores.sparkSession) as tables:
        rows = tables.stored(scores.dropna(subset=names) if positive else scores)
        n = rows.count()
        own = rows.select("combo", F.inline(F.array(*[F.struct(F.lit(i).alias("sub"), F.col(s).alias("score")) for i, s in enumerate(names)]))).filter("score IS NOT NULL")
        cuts = own.groupBy("sub").agg(F.percentile_approx("score", [i / parts for i in range(1, parts)], 10_000).alias("cuts"))
        cut = own.join(F.broadcast(cuts), "sub").select("combo", "sub", "score", F.size(F.filter("cuts", lambda c: F.col("score") <= c)).alias("part"))
        sizes = cut.groupBy("sub", "part").agg(F.count("*").alias("n"))
        before = sizes.select("sub", "part", (F.sum("n").over(Window.partitionBy("sub").orderBy("part")) - F.col("n")).alias("before"))
        inside = F.row_number().over(Window.partitionBy("sub", "part").orderBy(F.desc("score"), "combo"))
        places = cut.withColumn("at", inside).join(F.broadcast(before), ["sub", "part"])
        each = [F.max(F.when(F.col("sub") == i, F.col("before") + F.col("at"))).alias(f"r{i}") for i in range(len(names))]
        out = rows.join(places.groupBy("combo").agg(*each), "combo", "left").withColumns({f"r{i}": F.coalesce(f"r{i}", F.lit(n)).cast("long") for i in range(len(names))})
        total = sum((F.col(f"r{i}") * w for i, w in enumerate(weights(len(names)))), F.lit(0.0))
        return tables.kept(out.withColumn("weighted_rank", total))
