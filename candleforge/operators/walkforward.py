"""Walk-forward windows, parameter smoothing, subperiods and portfolio ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def windows(n: int, train: int, test: int) -> list[tuple[int, int, int, int]]:
    """(train start, train end, test start, test end), ends exclusive; offset so that the last test ends with the data."""
    start, out = (n - train) % test, []
    while start + train < n:
        end = min(start + train + test, n)
        if end - start - train >= test / 2:
            out.append((start, start + train, start + train, end))
        start += test
    return out


def windows_table(spark: SparkSession, n: int, train: int, test: int) -> DataFrame:
    return spark.createDataFrame([(i, *w) for i, w in enumerate(windows(n, train, test))], "win long, train_from long, train_to long, test_from long, test_to long")


def walk_forward(daily: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Per window: the key of the largest training profit (the first on ties) and what it earned in the test span.

    The windows are a small table, broadcast against the daily rows.
    """
    rows = daily.join(F.broadcast(spans), (F.col("idx") >= F.col("train_from")) & (F.col("idx") < F.col("test_to")))
    sums = rows.groupBy("win", key).agg(
        F.sum(F.when(F.col("idx") < F.col("train_to"), F.col("profit")).otherwise(0.0)).alias("train"),
        F.sum(F.when(F.col("idx") >= F.col("test_from"), F.col("profit")).otherwise(0.0)).alias("test"),
    )
    best = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("train"), key))
    return sums.withColumn("_r", best).filter("_r = 1").drop("_r")


def smoothed(choices: DataFrame, grid: list[float], alpha: float = 0.3) -> DataFrame:
    """Exponential average of the chosen parameter over windows, snapped to the nearest grid value (the first on ties)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("win", "param"))), lambda s: s["param"])
    mean = F.aggregate(F.slice(ordered, F.lit(2), F.size(ordered)), F.get(ordered, F.lit(0)), lambda s, x: F.lit(alpha) * x + F.lit(1 - alpha) * s)
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("mean") - g).alias("d"), F.lit(i).alias("i"), F.lit(float(g)).alias("g")) for i, g in enumerate(grid)]))["g"]
    return choices.groupBy().agg(mean.alias("mean")).withColumn("param", near)


def portfolios(ids: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """Each set of ``least`` to ``most`` of a short list of strategies (idx from 0, strategy): combo and member.

    A set's number has a bit for each of its members, so sets are numbers of a distributed range with so many bits.
    """
    n = ids.count()
    sets = ids.sparkSession.range(1, 1 << n).withColumnRenamed("id", "combo").filter(F.bit_count("combo").between(least, most))
    bits = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return sets.withColumn("idx", bits).filter(F.expr("getbit(combo, CAST(idx AS INT)) = 1")).join(F.broadcast(ids), "idx").select("combo", "strategy")


def score(members: DataFrame, daily: DataFrame, capital: float = 1000.0) -> DataFrame:
    """Net gain and drawdown in percent, R2 of the equity and Calmar of each combination, with capital for each member."""
    size = members.groupBy("combo").agg(F.count("*").alias("k"))
    days = members.join(daily, "strategy").groupBy("combo", "idx").agg(F.sum("profit").alias("profit")).join(size, "combo")
    past = Window.partitionBy("combo").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    base = F.col("k") * capital
    curve = days.withColumn("equity", base + F.sum("profit").over(past)).withColumn("peak", F.greatest(base, F.max("equity").over(past))).withColumn("n", F.row_number().over(past))
    fall = F.when(F.col("peak") > 0, (F.col("equity") - F.col("peak")) / F.col("peak") * 100.0)
    sums = curve.groupBy("combo").agg((F.sum("profit") / F.max(base) * 100.0).alias("net_gain"), F.min(fall).alias("max_drawdown"), F.regr_r2("equity", "n").alias("r2"))
    return sums.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("net_gain") / -F.col("max_drawdown")))


def placed(rows: DataFrame, by: str, tie: str, name: str, parts: int = 200) -> DataFrame:
    """``rows`` with their place by falling ``by``, then ``tie``; missing values come last. No window holds all rows:
    quantiles cut them to ranges, rows are placed inside these, and sizes of ranges are summed up."""
    cuts = sorted(set(rows.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []))
    part = F.when(F.col(by).isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: F.col(by) <= c)))
    rows = rows.withColumn("_part", F.when(F.col(by).isNull(), F.lit(parts + 1)).otherwise(part))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc_nulls_last(by), tie))
    return rows.withColumn("_at", inside).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_before", "_at")


def ranked(scores: DataFrame, n: int) -> DataFrame:
    """Top n by mean rank of gain and drawdown; missing values rank last. The scores, a row each, are read several times."""
    first = placed(scores.persist(), "net_gain", "combo", "r1").persist()
    rows = placed(first, "max_drawdown", "combo", "r2_")
    return rows.withColumn("rank", (F.col("r1") + F.col("r2_")) / 2.0).orderBy("rank", "combo").limit(n).drop("r1", "r2_")
