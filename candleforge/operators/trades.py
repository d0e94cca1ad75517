"""Trade tables and their metrics: daily profit, equity, drawdown, ratios, rollups, rounds and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candleforge.sources.bars import table

CAPITAL, DAYS_A_YEAR = 1000.0, 252

#: DuckDB text of the trades below.
TRADES_SQL = """(SELECT o_orderpriority AS strategy, l_returnflag || l_linestatus AS symbol, l_orderkey * 10 + l_linenumber AS trade_id,
 CASE WHEN l_linenumber % 2 = 0 THEN 'SHORT' ELSE 'LONG' END AS side, epoch_us(o_orderdate) // 86400000000 AS buy_day,
 epoch_us(l_shipdate) // 86400000000 AS sell_day, l_quantity AS qty, l_extendedprice * (l_discount - 0.05) / 1000.0 AS profit, l_tax AS fee,
 CASE l_returnflag WHEN 'A' THEN 'TP' WHEN 'R' THEN 'SL' ELSE 'SELL_AFTER' END AS exit_reason
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades from order to shipping day, in whole epoch days."""
    days = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.filter("l_shipdate >= o_orderdate").select(
        F.col("o_orderpriority").alias("strategy"), F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"), F.when(F.col("l_linenumber") % 2 == 0, "SHORT").otherwise("LONG").alias("side"),
        days("o_orderdate").alias("buy_day"), days("l_shipdate").alias("sell_day"), F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.05) / 1000.0).alias("profit"), F.col("l_tax").alias("fee"),
        F.when(F.col("l_returnflag") == "A", "TP").when(F.col("l_returnflag") == "R", "SL").otherwise("SELL_AFTER").alias("exit_reason"),
    )


def trading_index(day: Column) -> Column:
    """Trading days since Monday 1970-01-05; a weekend day counts as the Friday before."""
    since = day - 4
    return (F.floor(since / 7) * 5 + F.least(F.pmod(since, F.lit(7)), F.lit(4))).cast("long")


TRADING_INDEX_SQL = "(floor((sell_day - 4) / 7.0) * 5 + least(((sell_day - 4) % 7 + 7) % 7, 4))::BIGINT"


def daily_profit(rows: DataFrame, key: str = "strategy") -> DataFrame:
    """Profit by key and trading day, with zeros on days without sales between the first and last one."""
    sums = rows.groupBy(key, trading_index(F.col("sell_day")).alias("idx")).agg(F.sum("profit").alias("profit")).filter(F.col(key).isNotNull() & F.col("idx").isNotNull())
    # Each row goes on to the day before the next, so the trades are read once.
    following = F.coalesce(F.lead("idx").over(Window.partitionBy(key).orderBy("idx")), F.col("idx") + 1)
    days = sums.withColumn("_to", following - 1).select(key, F.col("idx").alias("_from"), "profit", F.explode(F.sequence("idx", "_to")).alias("idx"))
    return days.select(key, "idx", F.when(F.col("idx") == F.col("_from"), F.coalesce("profit", F.lit(0.0))).otherwise(0.0).alias("profit"))


def equity(daily: DataFrame, key: str = "strategy", capital: float = CAPITAL) -> DataFrame:
    """Equity, its running peak (the capital at least) and the drawdown in percent, at or below 0."""
    past = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("equity", F.lit(capital) + F.sum("profit").over(past))
    rows = rows.withColumn("peak", F.greatest(F.lit(capital), F.max("equity").over(past)))
    return rows.withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("equity") - F.col("peak")) / F.col("peak") * 100.0))


def metrics(rows: DataFrame, key: str = "strategy", capital: float = CAPITAL) -> DataFrame:
    """Research metrics by key: gain, drawdown, Sharpe, skew, raw kurtosis, R2, win rate, profit factor, Calmar."""
    curve = equity(daily_profit(rows, key), key, capital)
    order = F.row_number().over(Window.partitionBy(key).orderBy("idx"))
    std = F.stddev_pop("profit")
    days = curve.withColumn("n", order).groupBy(key).agg(
        F.count("*").alias("n_days"), F.avg("profit").alias("mean"), std.alias("std"), F.min("drawdown").alias("max_drawdown"),
        (F.sum("profit") / capital * 100.0).alias("net_gain"), F.skewness("profit").alias("skew"), (F.kurtosis("profit") + 3.0).alias("kurtosis"),
        F.coalesce(F.regr_r2("equity", "n"), F.lit(1.0)).alias("r2"),
    )
    sharpe = F.when(F.col("std") > 0, F.col("mean") / F.col("std") * F.sqrt(F.lit(float(DAYS_A_YEAR))))
    sides = rows.groupBy(key).agg(
        F.count("*").alias("n_trades"), (F.count_if(F.col("profit") > 0) / F.count("*") * 100.0).alias("win_rate"),
        F.sum(F.greatest("profit", F.lit(0.0))).alias("won"), F.sum(F.greatest(-F.col("profit"), F.lit(0.0))).alias("lost"),
    )
    return days.join(sides, key).select(
        key, "n_days", "n_trades", "net_gain", "max_drawdown", F.when(F.abs(sharpe) <= 50, sharpe).alias("sharpe"), F.when(F.col("n_days") > 2, F.col("skew")).alias("skew"),
        F.when(F.col("n_days") > 2, F.col("kurtosis")).alias("kurtosis"), "r2", "win_rate", F.when(F.col("lost") > 0, F.col("won") / F.col("lost")).alias("profit_factor"),
        F.when(F.col("max_drawdown") < 0, F.col("net_gain") / -F.col("max_drawdown")).alias("calmar"),
    )


def weeks(daily: DataFrame, key: str = "strategy", capital: float = CAPITAL) -> DataFrame:
    """Last equity of each trading week, its change, and weeks since the last peak."""
    week = F.floor(F.col("idx") / 5).cast("long")
    rows = equity(daily, key, capital).groupBy(key, week.alias("week")).agg(F.max_by("equity", "idx").alias("equity"))
    by = Window.partitionBy(key).orderBy("week")
    past = by.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("equity", 1, capital).over(by)
    rows = rows.withColumn("change", F.when(before > 0, (F.col("equity") / before - 1.0) * 100.0)).withColumn("peak", F.greatest(F.lit(capital), F.max("equity").over(past)))
    at_peak = F.last(F.when(F.col("equity") >= F.col("peak"), F.col("week")), ignorenulls=True).over(past)
    return rows.withColumn("weeks_below", F.col("week") - F.coalesce(at_peak, F.min("week").over(Window.partitionBy(key)) - 1)).drop("peak")


def strategy_report(rows: DataFrame) -> DataFrame:
    """Counts, shares of reasons and of all winnings and losses, and mean duration by strategy."""
    won, lost = (F.sum(F.when(c, F.col("profit")).otherwise(0.0)) for c in (F.col("profit") > 0, F.col("profit") < 0))
    share = lambda reason: (F.count_if(F.col("exit_reason") == reason) / F.count("*") * 100.0).alias(f"pct_{reason.lower()}")
    own = rows.groupBy("strategy").agg(
        F.count("*").alias("n_trades"), F.sum("profit").alias("profit"), (F.count_if(F.col("profit") > 0) / F.count("*") * 100.0).alias("pct_positive"), won.alias("won"), lost.alias("lost"),
        share("TP"), share("SL"), share("SELL_AFTER"), F.avg(F.col("sell_day") - F.col("buy_day")).alias("mean_days"), F.min("buy_day").alias("first_open"),
    )
    # One row a strategy: a small window gives the totals.
    every = Window.partitionBy()
    return own.withColumns({"won_share": F.col("won") / F.sum("won").over(every) * 100.0, "lost_share": F.col("lost") / F.sum("lost").over(every) * 100.0}).drop("won", "lost")


def curves(rows: DataFrame) -> DataFrame:
    """Additive metrics by strategy, by side and overall in one pass of grouping sets."""
    view = rows.select("strategy", "side", "profit")
    out = view.groupingSets([["strategy"], ["side"], []], "strategy", "side").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n_trades"), F.sum("profit").alias("profit"), F.count_if(F.col("profit") > 0).alias("n_won")
    )
    name = F.when(F.col("level") == 3, "Combined").otherwise(F.coalesce("strategy", "side"))
    return out.select(name.alias("curve"), "n_trades", "profit", "n_won")


def rounds(rows: DataFrame, most_gap: int) -> DataFrame:
    """Runs of openings by symbol whose neighbours are at most ``most_gap`` apart: number, span and size."""
    by = Window.partitionBy("symbol").orderBy("us", "id")
    new = F.when(F.col("us") - F.lag("us").over(by) > most_gap, 1).otherwise(0)
    numbered = rows.withColumn("_new", new).withColumn("round", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("symbol", "round").agg(F.min("us").alias("from_us"), F.max("us").alias("to_us"), F.count("*").alias("n"))


def round_robin(ranked: DataFrame, n: int) -> DataFrame:
    """At most n strategies, taken in turn from the groups: the best of each, then the second of each, and so on."""
    place = F.row_number().over(Window.partitionBy("grp").orderBy("rank"))
    first = ranked.groupBy("grp").agg(F.min("rank").alias("grp_rank"))
    return ranked.withColumn("turn", place).join(first, "grp").orderBy("turn", "grp_rank").limit(n).select("id", "grp", "rank", F.col("turn").cast("long").alias("turn"))


def correlations(daily: DataFrame, key: str = "strategy") -> DataFrame:
    """Correlation of each pair of keys over the days of either, zeros where one has none, from sums of products."""
    n = daily.select("idx").distinct().count()
    moments = daily.groupBy(key).agg(F.sum("profit").alias("s"), F.sum(F.col("profit") * F.col("profit")).alias("q"))
    a, b = daily.select(F.col(key).alias("a"), "idx", F.col("profit").alias("x")), daily.select(F.col(key).alias("b"), "idx", F.col("profit").alias("y"))
    cross = a.join(b, "idx").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    ma, mb = moments.selectExpr(f"{key} AS a", "s AS sa", "q AS qa"), moments.selectExpr(f"{key} AS b", "s AS sb", "q AS qb")
    rows = cross.join(ma, "a").join(mb, "b")
    spread = F.sqrt((n * F.col("qa") - F.col("sa") * F.col("sa")) * (n * F.col("qb") - F.col("sb") * F.col("sb")))
    return rows.select("a", "b", F.when(spread > 0, (n * F.col("xy") - F.col("sa") * F.col("sb")) / spread).alias("corr"))


def wilson_lower(wins: Column, n: Column, z: float = 1.96) -> Column:
    p = wins / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def last_of_each(rows: DataFrame, n: int) -> DataFrame:
    """The last n trades of each strategy by day and id."""
    place = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("sell_day"), F.desc("trade_id")))
    return rows.withColumn("_r", place).filter(F.col("_r") <= n).drop("_r")


def exposure(rows: DataFrame, day: int, capital: float) -> DataFrame:
    """Of the trades open on a day: gross, net, long and short size in percent of capital plus closed profit."""
    held = (F.col("buy_day") <= day) & (F.col("sell_day") > day)
    size = lambda side: F.sum(F.when(held & (F.col("side") == side), F.col("qty")).otherwise(0.0))
    sums = rows.agg(size("LONG").alias("long"), size("SHORT").alias("short"), F.sum(F.when(F.col("sell_day") <= day, F.col("profit")).otherwise(0.0)).alias("closed"))
    base = F.lit(capital) + F.col("closed")
    pct = lambda x: F.when(base > 0, x / base * 100.0)
    return sums.select(pct(F.col("long") + F.col("short")).alias("gross"), pct(F.col("long") - F.col("short")).alias("net"), pct(F.col("long")).alias("long"), pct(F.col("short")).alias("short"))
