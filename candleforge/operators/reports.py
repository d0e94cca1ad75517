"""Filters, joins, selections and report figures over trades, candles and daily profits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candleforge.functions.stretches import in_order, stretched
from candleforge.operators import trades as base


# Tables.
def append_border(old: DataFrame, new: DataFrame, seconds: int) -> DataFrame:
    """By symbol: whether new bars follow the old ones at once (OK), start before their end (OVERLAP) or leave a GAP of so many."""
    a = old.groupBy("symbol").agg(F.max("t").alias("last_t"))
    b = new.groupBy("symbol").agg(F.min("t").alias("first_t"))
    missing = F.floor((F.col("first_t") - F.col("last_t")) / seconds).cast("long") - 1
    status = F.when(F.col("first_t") <= F.col("last_t"), "OVERLAP").when(missing > 0, "GAP").otherwise("OK")
    return a.join(b, "symbol").select("symbol", "last_t", "first_t", status.alias("status"), F.greatest(missing, F.lit(0)).alias("missing"))


def merge_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """One bar for each symbol and time; where both tables have one, the old one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in ("symbol", "t")]
    kept = both.groupBy("symbol", "t").agg(F.min_by(F.struct(*rest), "_new").alias("_row"))
    return kept.select("symbol", "t", *[F.col(f"_row.{c}").alias(c) for c in rest])


def volume_column(columns: list[str]) -> Column:
    """``volume`` where the table has it, else ``volume_quote``; missing values of the first are taken from the second."""
    return F.coalesce(*[F.col(c) for c in ("volume", "volume_quote") if c in columns])


def first_specs(specs: DataFrame, order: str) -> DataFrame:
    """The first spec of each (key, op, threshold), and whether later ones of the same identity have other parameters."""
    return specs.groupBy("key", "op", "threshold").agg(F.min(order).alias("first"), (F.countDistinct("params") > 1).alias("conflict"))


def trades_between(rows: DataFrame, first_day: int, last_day: int, strategies: list[str], symbols: list[str]) -> DataFrame:
    """Trades closed from the first to the last day, both included, of some strategies and symbols."""
    return rows.filter(F.col("sell_day").between(first_day, last_day) & F.col("strategy").isin(strategies) & F.col("symbol").isin(symbols))


def settled_days(rows: DataFrame) -> DataFrame:
    """Days all of whose trades are closed. ``rows`` has day and status."""
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.bool_and(F.col("status") == "CLOSED").alias("all_closed")).filter("all_closed").select("day", "n")


def faults(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A row for each check that a row fails; a missing value fails it too."""
    named = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])
    return rows.withColumn("fault", F.explode(F.array_compact(named)))


def with_variance(daily: DataFrame, key: str) -> DataFrame:
    """Rows of the keys whose daily values vary."""
    good = daily.groupBy(key).agg(F.min("profit").alias("a"), F.max("profit").alias("b")).filter("a < b").select(key)
    return daily.join(good, key, "left_semi")


def overlapping(rows: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """Rows whose span meets one of ``others`` of the same key and another trade."""
    o = others.select(F.col(key).alias("_key"), F.col("buy_day").alias("_from"), F.col("sell_day").alias("_to"), F.col("trade_id").alias("_id"))
    meets = (F.col(key) == F.col("_key")) & (F.col("trade_id") != F.col("_id")) & (F.col("buy_day") <= F.col("_to")) & (F.col("sell_day") >= F.col("_from"))
    return rows.join(o, meets, "left_semi")


# Selections.
def top_of_each(rows: DataFrame, key: str, value: str, tie: str, n: int) -> DataFrame:
    """The n largest rows of each key; Spark drops most of the rest before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), tie))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def suffix_largest(rows: DataFrame, key: str, order: str, value: str, k: int) -> DataFrame:
    """The k-th largest value from each row of a key on, null where fewer are left. Keys are short lists."""
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    left = F.collect_list(value).over(ahead)
    return rows.withColumn("largest", F.get(F.sort_array(left, asc=False), F.lit(k - 1)))


def best_combo(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the combo of the least p, then the largest z, then the first."""
    return rows.groupBy(key).agg(F.min_by(F.struct("combo", "p", "z"), F.struct("p", -F.col("z"), "combo")).alias("x")).select(key, "x.combo", "x.p", "x.z")


def slots(rows: DataFrame, group: str, order: list, free: int) -> DataFrame:
    """The first rows of each group, in order, for which there is room."""
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("slot") <= free)


# Figures.
def span_metrics(rows: DataFrame, first_day: int, last_day: int, capital: float = base.CAPITAL) -> DataFrame:
    """Gain and drawdown in percent of each strategy's trades closed in a span of days."""
    inside = rows.filter(F.col("sell_day").between(first_day, last_day))
    curve = base.equity(base.daily_profit(inside), capital=capital)
    return curve.groupBy("strategy").agg((F.sum("profit") / capital * 100.0).alias("net_gain"), F.min("drawdown").alias("max_drawdown"))


def monthly(rows: DataFrame, last_day: int) -> DataFrame:
    """Profit, trades and winners by strategy and calendar month; ``partial`` where the data ends inside the month."""
    date = F.date_from_unix_date(F.col("sell_day").cast("int"))
    month = F.date_format(F.trunc(date, "month"), "yyyy-MM")
    end = F.unix_date(F.last_day(F.max(date))).cast("long")
    return rows.groupBy("strategy", month.alias("month")).agg(
        F.count("*").alias("n"), F.sum("profit").alias("profit"), F.count_if(F.col("profit") > 0).alias("n_won"), (end > last_day).alias("partial")
    )


def capital_share(rows: DataFrame, capital: float) -> DataFrame:
    """Capital of each strategy: the whole by their number, 0 without any."""
    n = rows.agg(F.countDistinct("strategy").alias("n_strategies"))
    return n.select("n_strategies", F.when(F.col("n_strategies") > 0, F.lit(capital) / F.col("n_strategies")).otherwise(0.0).alias("capital"))


def assigned_series(daily: DataFrame, capital: float) -> DataFrame:
    """Equity in percent of a strategy's assigned capital, and its drawdown as a positive percentage of the peak."""
    curve = base.equity(daily, capital=capital)
    return curve.select("strategy", "idx", (F.col("equity") / capital * 100.0).alias("equity_pct"), (-F.col("drawdown")).alias("drawdown_pct"))


def spread_by_group(rows: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """Least, largest and 90th percentile of a value by group, the share at or above ``least``, and who has the largest."""
    return rows.groupBy(*keys).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.percentile(value, F.lit(0.9)).alias("p90"),
        (F.count_if(F.col(value) >= least) / F.count("*")).alias("pass_rate"), F.max_by("id", F.struct(F.col(value), F.col("id"))).alias("anchor"),
    )


def target_deviation(rows: DataFrame, configured: dict[str, float]) -> DataFrame:
    """Mean result in percent of trades that ended at target or stop, against the configured one."""
    pct = F.col("profit") / F.col("qty") * 100.0
    config = F.coalesce(*[F.when(F.col("exit_reason") == k, F.lit(v)) for k, v in configured.items()])
    hit = rows.filter(F.col("exit_reason").isin(list(configured)))
    return hit.groupBy("strategy", "exit_reason").agg(F.count("*").alias("n"), F.avg(pct).alias("mean_pct"), F.avg(pct - config).alias("deviation"))


def participation(values: DataFrame, key: str) -> DataFrame:
    """Effective number of members of each key: the square of the sum by the sum of squares."""
    s, q = F.sum("x"), F.sum(F.col("x") * F.col("x"))
    return values.groupBy(key).agg(F.when(q > 0, s * s / q).alias("n_eff"))


def gram_participation(daily: DataFrame, key: str = "strategy") -> DataFrame:
    """Effective number of independent columns: trace of the Gram matrix squared by its squared norm, from sums of products."""
    a, b = daily.select(F.col(key).alias("a"), "idx", F.col("profit").alias("x")), daily.select(F.col(key).alias("b"), "idx", F.col("profit").alias("y"))
    gram = a.join(b, "idx").filter("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g"))
    trace = F.sum(F.when(F.col("a") == F.col("b"), F.col("g")))
    norm = F.sum(F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0) * F.col("g") * F.col("g"))
    return gram.agg((trace * trace / norm).alias("n_eff"), F.countDistinct("a").alias("n"))


def market_bias(bars: DataFrame) -> DataFrame:
    """Mean buy-and-hold return of the symbols in percent, and the share of positive ones."""
    own = bars.groupBy("symbol").agg(((F.max_by("close", "t") / F.min_by("close", "t") - 1) * 100.0).alias("r"))
    return own.agg(F.count("*").alias("n"), F.avg("r").alias("mean_return"), (F.count_if(F.col("r") > 0) / F.count("*") * 100.0).alias("pct_positive"))


def closed_pnl(rows: DataFrame) -> DataFrame:
    """Result of closed trades: the reported profit less twice the fee, else the price difference times the size with no fee."""
    reported = F.col("api_profit").isNotNull()
    pnl = F.when(reported, F.col("api_profit") - 2 * F.col("fee")).otherwise((F.col("exit_price") - F.col("entry_price")) * F.col("size") * F.when(F.col("side") == "SHORT", -1).otherwise(1))
    notional = F.col("entry_price") * F.col("size")
    return rows.select("trade_id", pnl.alias("pnl"), F.when(reported, 2 * F.col("fee")).otherwise(0.0).alias("fees"), F.when(notional > 0, pnl / notional * 100.0).alias("pct"), (F.col("sell_day") - F.col("buy_day")).alias("days"))


def fill_fees(rows: DataFrame) -> DataFrame:
    """Fills of an order with a nested list of fees: their absolute sum, split by opening and closing fills, by year."""
    total = F.aggregate("fee_detail", F.lit(0.0), lambda s, f: s + F.abs(f["fee"]))
    own = rows.withColumn("fee", total)
    of = lambda side: F.sum(F.when(F.lower(F.trim("action")) == side, F.col("fee")).otherwise(0.0))
    return own.groupBy("year").agg(F.sum("fee").alias("fees"), of("open").alias("open_fees"), of("close").alias("close_fees"), F.sum("pnl").alias("pnl"))


def dashboard(rows: DataFrame, capital: float = base.CAPITAL) -> DataFrame:
    """Dashboard figures by strategy: profit factor 0 without losses, weeks won, drawdown trade by trade as a positive
    percentage, Sharpe of daily changes of equity with the sample spread, and R2 of the trade curve within 0 to 1.

    The trade curve of a strategy is summed in two steps, by day and inside the day.
    """
    by_day = rows.groupBy("strategy", "sell_day").agg(F.sum("profit").alias("p"))
    past = Window.partitionBy("strategy").orderBy("sell_day")
    days = by_day.withColumn("after", F.lit(capital) + F.sum("p").over(past)).withColumn("before", F.col("after") - F.col("p"))
    change = days.withColumn("c", F.col("after") / F.lag("after").over(past) - 1.0)
    sharpe = change.groupBy("strategy").agg(F.when(F.stddev_samp("c") > 0, F.avg("c") / F.stddev_samp("c") * F.sqrt(F.lit(252.0))).alias("sharpe"))
    week = F.floor((F.col("sell_day") + 3) / 7)
    weeks = rows.groupBy("strategy", week.alias("week")).agg(F.sum("profit").alias("p")).groupBy("strategy").agg((F.count_if(F.col("p") > 0) / F.count("*") * 100.0).alias("weeks_won"))
    inside = Window.partitionBy("strategy", "sell_day").orderBy("trade_id").rowsBetween(Window.unboundedPreceding, 0)
    curve = rows.join(days.select("strategy", "sell_day", "before"), ["strategy", "sell_day"])
    curve = curve.withColumn("equity", F.col("before") + F.sum("profit").over(inside))
    day_top = curve.groupBy("strategy", "sell_day").agg(F.max("equity").alias("top"))
    earlier = day_top.withColumn("peak_before", F.greatest(F.lit(capital), F.max("top").over(past.rowsBetween(Window.unboundedPreceding, -1)))).drop("top")
    curve = curve.join(earlier, ["strategy", "sell_day"]).withColumn("peak", F.greatest("peak_before", F.max("equity").over(inside)))
    worst = curve.groupBy("strategy").agg(F.max((F.col("peak") - F.col("equity")) / F.col("peak") * 100.0).alias("max_drawdown"))
    won, lost = F.sum(F.greatest("profit", F.lit(0.0))), F.sum(F.greatest(-F.col("profit"), F.lit(0.0)))
    factor = rows.groupBy("strategy").agg(F.count("*").alias("n"), F.when(lost > 0, won / lost).otherwise(0.0).alias("profit_factor"))
    return factor.join(weeks, "strategy").join(sharpe, "strategy").join(worst, "strategy")


def weighted_correlation(rows: DataFrame, x: str, y: str, w: str) -> Column:
    """Pearson correlation with weights, of an aggregation over ``rows``."""
    s = lambda c: F.sum(c)
    W, X, Y = F.col(w), F.col(x), F.col(y)
    mx, my = s(W * X) / s(W), s(W * Y) / s(W)
    cov = s(W * X * Y) / s(W) - mx * my
    return cov / F.sqrt((s(W * X * X) / s(W) - mx * mx) * (s(W * Y * Y) / s(W) - my * my))


def bar_step(bars: DataFrame) -> DataFrame:
    """The most frequent gap between a symbol's bars, the least of equals."""
    rows = stretched(bars.select("symbol", "t"), back=1).withColumn("gap", F.col("t") - F.lag("t").over(in_order())).filter("_own AND gap IS NOT NULL")
    counts = rows.groupBy("symbol", "gap").agg(F.count("*").alias("n"))
    return counts.groupBy("symbol").agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("step"), F.max("n").alias("n"))


def slot_medians(bars: DataFrame, hours: int, n: int) -> DataFrame:
    """Median of the volumes of the ``n`` bars before in the same slot of the day; null with fewer."""
    slot = F.floor(F.pmod("t", F.lit(86_400)) / (3600 * hours)).cast("long")
    rows = bars.withColumn("key", F.struct("symbol", slot.alias("slot")))
    rows = stretched(rows, back=n, key="key")
    past = in_order("key").rowsBetween(-n, -1)
    values = F.sort_array(F.collect_list("volume").over(past))
    middle = (F.get(values, F.lit((n - 1) // 2)) + F.get(values, F.lit(n // 2))) / 2.0
    return rows.withColumn("median", F.when(F.count("volume").over(past) == n, middle)).filter("_own").select("symbol", "t", "key.slot", "volume", "median")


# Walk-forward.
def eligible(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows that each symbol's data covers from the training start to the test end. Windows are a small table."""
    return spans.join(F.broadcast(windows), (F.col("first") <= F.col("train_from")) & (F.col("last") >= F.col("test_to") - 1)).select("symbol", "win")


def padded(windows: DataFrame, sell_after: int, warm_up: int = 100, cool_down: int = 100) -> DataFrame:
    """First and last bar, end exclusive, that a window's test needs: bars before it for indicators and after it for exits."""
    return windows.select("win", F.greatest(F.col("test_from") - warm_up, F.lit(0)).alias("bar_from"), (F.col("test_to") + max(sell_after, cool_down) + 1).alias("bar_to"))


def approval(windows: DataFrame, rows: DataFrame, train_months: float, test_months: float, gain: float = 10.0, drawdown: float = 30.0, r2: float = 0.5, wfr: float = 0.5) -> DataFrame:
    """Verdict by key. ``windows`` has train and test gain of each window (null where it had no trade), ``rows`` the metrics
    of the joined test trades. The ratio is test by training gain a month; a window without trades, but for the last, rejects.
    """
    last = F.col("win") == F.max("win").over(Window.partitionBy("key"))
    sums = windows.withColumn("last", last).groupBy("key").agg(
        F.avg("train").alias("train"), F.avg("test").alias("test"), F.coalesce(F.bool_or(F.col("train").isNull() & ~F.col("last")), F.lit(False)).alias("empty")
    )
    monthly_train = F.col("train") / train_months
    ratio = F.when(monthly_train > 0, F.col("test") / test_months / monthly_train).otherwise(0.0)
    good = ~F.col("empty") & (F.col("net_gain") >= gain) & (F.abs("max_drawdown") <= drawdown) & (F.col("r2") >= r2) & (F.col("wfr") >= wfr)
    return sums.join(rows, "key").withColumn("wfr", ratio).select("key", "wfr", "net_gain", "max_drawdown", "r2", F.coalesce(good, F.lit(False)).alias("approved"))


def block_size(bars_a_day: int, sell_after: int) -> int:
    """Days of a bootstrap block: those that the longest trade spans, one at least."""
    return max(1, math.ceil(sell_after / bars_a_day))
