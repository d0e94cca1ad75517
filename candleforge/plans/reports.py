"""More registered queries: filters, joins, selections, report figures and walk-forward verdicts, with DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from candleforge.operators import etl, reports, rules, trades, walkforward
from candleforge.operators.indicators import REGISTRY, indicator_sql
from candleforge.plans.catalog import D1, DAILY_SQL, EQUITY_SQL, H1, H4, HITS_SQL, T, WF_SQL, _daily, _wf_rows, query, r
from candleforge.sources.bars import bars, table

CUT = 19_737  # epoch day of 2024-01-15
OLD_SQL, NEW_SQL = f"(SELECT * FROM {H1} WHERE t < {CUT * 86_400} AND t % 7 <> 0 OR t < {CUT * 86_400 - 7200})", f"(SELECT * REPLACE (close + 1 AS close) FROM {H1} WHERE t >= {CUT * 86_400 - 36_000})"


def _old_new(spark, sf_dir):
    rows = bars(spark, sf_dir)
    old = rows.filter((F.col("t") < CUT * 86_400) & (F.col("t") % 7 != 0) | (F.col("t") < CUT * 86_400 - 7200))
    return old, rows.filter(F.col("t") >= CUT * 86_400 - 36_000).withColumn("close", F.col("close") + 1)


@query(f"""SELECT symbol, last_t, first_t, CASE WHEN first_t <= last_t THEN 'OVERLAP' WHEN m > 0 THEN 'GAP' ELSE 'OK' END AS status, greatest(m, 0) AS missing FROM (SELECT a.symbol, last_t, first_t, CAST(floor((first_t - last_t) / 3600.0) AS BIGINT) - 1 AS m
 FROM (SELECT symbol, max(t) AS last_t FROM {OLD_SQL} GROUP BY 1) a JOIN (SELECT symbol, min(t) AS first_t FROM {NEW_SQL} WHERE symbol <> 'click' OR t > {CUT * 86_400} GROUP BY 1) b USING (symbol))""")
def append_border(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return reports.append_border(old, new.filter((F.col("symbol") != "click") | (F.col("t") > CUT * 86_400)), 3600)


@query(f"SELECT symbol, t, open, high, low, close, volume FROM {OLD_SQL} UNION ALL SELECT n.symbol, n.t, n.open, n.high, n.low, n.close, n.volume FROM {NEW_SQL} n ANTI JOIN {OLD_SQL} o ON n.symbol = o.symbol AND n.t = o.t")
def merge_bars(spark, sf_dir):
    return reports.merge_bars(*_old_new(spark, sf_dir))


@query(f"SELECT symbol, t, coalesce(CASE WHEN t // 3600 % 4 <> 0 THEN volume END, close * volume) AS volume FROM {H1}")
def volume_column(spark, sf_dir):
    rows = bars(spark, sf_dir).select("symbol", "t", F.when(F.floor(F.col("t") / 3600) % 4 != 0, F.col("volume")).alias("volume"), (F.col("close") * F.col("volume")).alias("volume_quote"))
    return rows.select("symbol", "t", reports.volume_column(rows.columns).alias("volume"))


@query("SELECT key, op, threshold, min(first) AS first, count(DISTINCT params) > 1 AS conflict FROM (SELECT l_returnflag AS key, l_linestatus AS op, l_quantity AS threshold, l_linenumber % 2 AS params, l_orderkey * 10 + l_linenumber AS first FROM lineitem) GROUP BY 1, 2, 3")
def spec_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("op"), F.col("l_quantity").alias("threshold"), (F.col("l_linenumber") % 2).alias("params"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return reports.first_specs(rows, "at")


@query(f"SELECT trade_id, strategy, symbol, sell_day FROM {T} WHERE sell_day BETWEEN 9000 AND 9800 AND strategy IN ('1-URGENT', '5-LOW') AND symbol IN ('AF', 'NO')")
def trades_between(spark, sf_dir):
    return reports.trades_between(trades.trades(spark, sf_dir), 9000, 9800, ["1-URGENT", "5-LOW"], ["AF", "NO"]).select("trade_id", "strategy", "symbol", "sell_day")


@query(f"SELECT day, n FROM (SELECT buy_day AS day, count(*) AS n, bool_and(sell_day <= 9900) AS done FROM {T} GROUP BY 1) WHERE done")
def settled_days(spark, sf_dir):
    status = F.when(F.col("sell_day") <= 9900, "CLOSED").otherwise("OPEN")
    return reports.settled_days(trades.trades(spark, sf_dir).select(F.col("buy_day").alias("day"), status.alias("status")))


@query(f"""SELECT trade_id, fault FROM (SELECT trade_id, unnest([CASE WHEN NOT qty >= 5 THEN 'qty' END, CASE WHEN NOT regexp_matches(strategy, '^[1-5]-[A-Z ]+$') THEN 'strategy' END, CASE WHEN NOT fee < 0.08 THEN 'fee' END,
 CASE WHEN NOT coalesce(abs(profit) <= 3, false) THEN 'profit' END, CASE WHEN NOT sell_day - buy_day <= 120 THEN 'duration' END]) AS fault FROM {T}) WHERE fault IS NOT NULL""")
def trade_faults(spark, sf_dir):
    checks = {"qty": F.col("qty") >= 5, "strategy": F.col("strategy").rlike("^[1-5]-[A-Z ]+$"), "fee": F.col("fee") < 0.08, "profit": F.abs("profit") <= 3, "duration": F.col("sell_day") - F.col("buy_day") <= 120}
    return reports.faults(trades.trades(spark, sf_dir), checks).select("trade_id", "fault")


@query("SELECT event_id, TRY_CAST(raw AS DOUBLE) AS value FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) || '.5' END AS raw FROM events)")
def numeric_coercion(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").when(F.col("event_id") % 7 == 0, None).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", etl.to_number("raw").alias("value"))


@query(f"SELECT strategy, idx, round(profit, 8) AS profit FROM (SELECT *, min(profit) OVER (PARTITION BY strategy) AS a, max(profit) OVER (PARTITION BY strategy) AS b FROM (SELECT strategy, idx, CASE WHEN strategy LIKE '3%' THEN 0.0 ELSE profit END AS profit FROM {DAILY_SQL})) WHERE a < b")
def varying_columns(spark, sf_dir):
    flat = _daily(spark, sf_dir).withColumn("profit", F.when(F.col("strategy").startswith("3"), 0.0).otherwise(F.col("profit")))
    return reports.with_variance(flat, "strategy").select("strategy", "idx", r("profit", 8))


CUSTOMER_SQL = f"(SELECT t.*, o_custkey AS customer FROM {T} t JOIN orders ON trade_id // 10 = o_orderkey)"


@query(f"SELECT trade_id FROM {CUSTOMER_SQL} a WHERE side = 'LONG' AND EXISTS (SELECT 1 FROM {CUSTOMER_SQL} b WHERE b.side = 'SHORT' AND b.customer = a.customer AND b.trade_id <> a.trade_id AND a.buy_day <= b.sell_day AND a.sell_day >= b.buy_day)")
def overlap_semi_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"))
    rows = trades.trades(spark, sf_dir).join(orders, F.floor(F.col("trade_id") / 10) == F.col("order"))
    return reports.overlapping(rows.filter("side = 'LONG'"), "customer", rows.filter("side = 'SHORT'")).select("trade_id")


@query("SELECT coalesce(n_name, 'UNMAPPED') AS nation, count(*) AS n FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey GROUP BY 1")
def map_join_report(spark, sf_dir):
    names = table(spark, sf_dir, "nation").filter("n_nationkey % 3 <> 0").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.coalesce("n_name", F.lit("UNMAPPED")).alias("nation")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_old, count(*) FILTER (b AND NOT a) AS only_new, count(*) AS either FROM (SELECT symbol, t, bool_or(k = 0) AS a, bool_or(k = 1) AS b FROM (SELECT symbol, t, 0 AS k FROM {OLD_SQL} UNION ALL SELECT symbol, t, 1 FROM {NEW_SQL}) GROUP BY 1, 2)")
def set_operations(spark, sf_dir):
    old, new = (x.select("symbol", "t") for x in _old_new(spark, sf_dir))
    sizes = [(old.intersect(new), "both"), (old.subtract(new), "only_old"), (new.subtract(old), "only_new"), (old.union(new).distinct(), "either")]
    out = None
    for rows, name in sizes:
        one = rows.agg(F.count("*").alias(name))
        out = one if out is None else out.join(one)
    return out


@query(f"SELECT strategy, trade_id, round(profit, 6) AS profit, place FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY profit DESC, trade_id) AS place FROM {T}) WHERE place <= 50")
def top_of_each(spark, sf_dir):
    return reports.top_of_each(trades.trades(spark, sf_dir), "strategy", "profit", "trade_id", 50).select("strategy", "trade_id", r("profit"), "place")


@query(f"SELECT symbol, strategy, round(p, 6) AS p, round(list_sort(list(p) OVER (PARTITION BY symbol ORDER BY strategy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'DESC')[2], 6) AS largest FROM (SELECT symbol, strategy, sum(profit) AS p FROM {T} GROUP BY 1, 2)")
def suffix_second_largest(spark, sf_dir):
    sums = trades.trades(spark, sf_dir).groupBy("symbol", "strategy").agg(F.sum("profit").alias("p"))
    return reports.suffix_largest(sums, "symbol", "strategy", "p", 2).select("symbol", "strategy", r("p"), r("largest"))


@query(f"SELECT strategy, arg_min(combo, (p, -z, combo)) AS combo, min(p) AS p, round(arg_min(z, (p, -z, combo)), 6) AS z FROM (SELECT strategy, symbol || side AS combo, round(count(*) FILTER (profit <= 0) / count(*), 1) AS p, avg(profit) AS z FROM {T} GROUP BY 1, 2) GROUP BY 1")
def best_combo(spark, sf_dir):
    p = F.round(F.count_if(F.col("profit") <= 0) / F.count("*"), 1)
    sums = trades.trades(spark, sf_dir).groupBy("strategy", F.concat("symbol", "side").alias("combo")).agg(p.alias("p"), F.avg("profit").alias("z"))
    return reports.best_combo(sums, "strategy").select("strategy", "combo", "p", r("z"))


@query(f"SELECT buy_day, trade_id, symbol, slot FROM (SELECT *, row_number() OVER (PARTITION BY buy_day ORDER BY symbol, trade_id) AS slot FROM {T}) WHERE slot <= 20")
def slot_cap(spark, sf_dir):
    return reports.slots(trades.trades(spark, sf_dir), "buy_day", ["symbol", "trade_id"], 20).select("buy_day", "trade_id", "symbol", "slot")


@query(f"SELECT spec_id, symbol, t = last_t AS live FROM (SELECT spec_id, symbol, max(t) AS t FROM {HITS_SQL} GROUP BY 1, 2) JOIN (SELECT symbol, max(t) AS last_t FROM {H1} GROUP BY 1) USING (symbol)")
def last_bar_signals(spark, sf_dir):
    rows = bars(spark, sf_dir)
    last = rows.groupBy("symbol").agg(F.max("t").alias("last_t"))
    hits = rules.hits(rows).groupBy("spec_id", "symbol").agg(F.max("t").alias("t"))
    return hits.join(last, "symbol").select("spec_id", "symbol", (F.col("t") == F.col("last_t")).alias("live"))


SPAN_T = f"(SELECT * FROM {T} WHERE sell_day BETWEEN 9100 AND 9465)"


@query(f"""WITH {{d}} SELECT strategy, round(sum(profit) / 10.0, 4) AS net_gain, round(min(drawdown), 4) AS max_drawdown FROM (SELECT *, (equity - peak) / peak * 100.0 AS drawdown FROM (SELECT *, greatest(1000.0, max(equity) OVER (PARTITION BY strategy ORDER BY idx)) AS peak
 FROM (SELECT *, 1000.0 + sum(profit) OVER (PARTITION BY strategy ORDER BY idx) AS equity FROM d))) GROUP BY 1""".replace("{d}", f"d AS {DAILY_SQL.replace(T, SPAN_T)}"))
def span_metrics(spark, sf_dir):
    return reports.span_metrics(trades.trades(spark, sf_dir), 9100, 9465).select("strategy", r("net_gain", 4), r("max_drawdown", 4))


@query(f"""SELECT strategy, strftime(d, '%Y-%m') AS month, count(*) AS n, round(sum(profit), 4) AS profit, count(*) FILTER (profit > 0) AS n_won, CAST(epoch(last_day(max(d))) // 86400 AS BIGINT) > 10500 AS partial FROM (SELECT *, DATE '1970-01-01' + CAST(sell_day AS INT) AS d FROM {T}) GROUP BY 1, 2""")
def monthly_rollup(spark, sf_dir):
    return reports.monthly(trades.trades(spark, sf_dir), 10_500).select("strategy", "month", "n", r("profit", 4), "n_won", "partial")


@query(f"SELECT count(DISTINCT strategy) AS n_strategies, 10000.0 / count(DISTINCT strategy) AS capital FROM {T}")
def capital_share(spark, sf_dir):
    return reports.capital_share(trades.trades(spark, sf_dir), 10_000.0)


@query(f"SELECT strategy, idx, round(equity / 10.0, 4) AS equity_pct, round(-drawdown, 4) AS drawdown_pct FROM {EQUITY_SQL}")
def assigned_series(spark, sf_dir):
    return reports.assigned_series(_daily(spark, sf_dir), 1000.0).select("strategy", "idx", r("equity_pct", 4), r("drawdown_pct", 4))


GROUPS_SQL = f"(SELECT strategy || symbol AS id, side, strategy, sum(profit) AS gain FROM {T} GROUP BY strategy, symbol, side)"


@query(f"SELECT side, strategy, round(min(gain), 4) AS low, round(max(gain), 4) AS high, round(quantile_cont(gain, 0.9), 4) AS p90, round(count(*) FILTER (gain >= 0) / count(*), 6) AS pass_rate, arg_max(id, (gain, id)) AS anchor FROM {GROUPS_SQL} GROUP BY 1, 2")
def spread_by_group(spark, sf_dir):
    sums = trades.trades(spark, sf_dir).groupBy("strategy", "symbol", "side").agg(F.sum("profit").alias("gain")).withColumn("id", F.concat("strategy", "symbol"))
    return reports.spread_by_group(sums, ["side", "strategy"], "gain", 0.0).select("side", "strategy", r("low", 4), r("high", 4), r("p90", 4), r("pass_rate"), "anchor")


@query(f"SELECT strategy, exit_reason, count(*) AS n, round(avg(profit / qty * 100.0), 4) AS mean_pct, round(avg(profit / qty * 100.0 - CASE exit_reason WHEN 'TP' THEN 5.0 ELSE -5.0 END), 4) AS deviation FROM {T} WHERE exit_reason IN ('TP', 'SL') GROUP BY 1, 2")
def target_deviation(spark, sf_dir):
    return reports.target_deviation(trades.trades(spark, sf_dir), {"TP": 5.0, "SL": -5.0}).select("strategy", "exit_reason", "n", r("mean_pct", 4), r("deviation", 4))


@query(f"SELECT strategy, round(pow(sum(x), 2) / sum(x * x), 4) AS n_eff FROM (SELECT strategy, symbol, CAST(count(*) AS DOUBLE) AS x FROM {T} GROUP BY 1, 2) GROUP BY 1")
def participation_ratio(spark, sf_dir):
    counts = trades.trades(spark, sf_dir).groupBy("strategy", "symbol").agg(F.count("*").cast("double").alias("x"))
    return reports.participation(counts, "strategy").select("strategy", r("n_eff", 4))


@query(f"WITH d AS {DAILY_SQL}, g AS (SELECT a.strategy AS a, b.strategy AS b, sum(a.profit * b.profit) AS g FROM d a JOIN d b ON a.idx = b.idx GROUP BY 1, 2) SELECT round(pow(sum(g) FILTER (a = b), 2) / sum(g * g), 4) AS n_eff, count(DISTINCT a) AS n FROM g")
def gram_participation(spark, sf_dir):
    return reports.gram_participation(_daily(spark, sf_dir)).select(r("n_eff", 4), "n")


@query(f"SELECT count(*) AS n, round(avg(x), 4) AS mean_return, round(count(*) FILTER (x > 0) / count(*) * 100.0, 4) AS pct_positive FROM (SELECT symbol, (arg_max(close, t) / arg_min(close, t) - 1) * 100.0 AS x FROM {H1} GROUP BY 1)")
def market_bias(spark, sf_dir):
    return reports.market_bias(bars(spark, sf_dir)).select("n", r("mean_return", 4), r("pct_positive", 4))


@query(f"""WITH d AS (SELECT strategy, idx, profit FROM {DAILY_SQL}), i AS (SELECT DISTINCT idx FROM d), s AS (SELECT DISTINCT strategy FROM d), f AS (SELECT s.strategy, i.idx, coalesce(d.profit, 0) AS profit FROM s CROSS JOIN i LEFT JOIN d ON d.strategy = s.strategy AND d.idx = i.idx)
 SELECT round(avg(c), 5) AS mean_corr, count(*) AS pairs FROM (SELECT corr(x.profit, y.profit) AS c FROM f x JOIN f y ON x.idx = y.idx AND x.strategy < y.strategy GROUP BY x.strategy, y.strategy)""")
def mean_correlation(spark, sf_dir):
    return trades.correlations(_daily(spark, sf_dir)).agg(F.round(F.avg("corr"), 5).alias("mean_corr"), F.count("*").alias("pairs"))


@query(f"""SELECT trade_id, round(pnl, 8) AS pnl, fees, round(pnl / (entry_price * qty) * 100.0, 4) AS pct, sell_day - buy_day AS days FROM (SELECT *, CASE WHEN trade_id % 3 > 0 THEN profit - 2 * fee ELSE (entry_price + profit - entry_price) * qty * CASE side WHEN 'SHORT' THEN -1 ELSE 1 END END AS pnl,
 CASE WHEN trade_id % 3 > 0 THEN 2 * fee ELSE 0.0 END AS fees FROM (SELECT *, 10.0 + trade_id % 100 AS entry_price FROM {T}))""")
def closed_pnl(spark, sf_dir):
    entry = F.lit(10.0) + F.col("trade_id") % 100
    rows = trades.trades(spark, sf_dir).withColumns({"entry_price": entry, "exit_price": entry + F.col("profit"), "size": F.col("qty"), "api_profit": F.when(F.col("trade_id") % 3 > 0, F.col("profit"))})
    return reports.closed_pnl(rows).select("trade_id", r("pnl", 8), "fees", r("pct", 4), "days")


@query(f"""SELECT year, round(sum(f), 4) AS fees, round(coalesce(sum(f) FILTER (o), 0), 4) AS open_fees, round(coalesce(sum(f) FILTER (NOT o), 0), 4) AS close_fees, round(sum(profit), 4) AS pnl FROM (SELECT CAST(year(DATE '1970-01-01' + CAST(sell_day AS INT)) AS INT) AS year, abs(-fee) + abs(fee / 2) AS f, trade_id % 2 = 0 AS o, profit FROM {T}) GROUP BY 1""")
def fill_fees(spark, sf_dir):
    rows = trades.trades(spark, sf_dir).select(
        F.year(F.date_from_unix_date(F.col("sell_day").cast("int"))).alias("year"), F.when(F.col("trade_id") % 2 == 0, " Open ").otherwise("CLOSE").alias("action"),
        F.array(F.struct((-F.col("fee")).alias("fee")), F.struct((F.col("fee") / 2).alias("fee"))).alias("fee_detail"), F.col("profit").alias("pnl"),
    )
    return reports.fill_fees(rows).select("year", r("fees", 4), r("open_fees", 4), r("close_fees", 4), r("pnl", 4))


@query(f"""WITH t AS {T}, d AS (SELECT strategy, sell_day, sum(profit) AS p FROM t GROUP BY 1, 2), e AS (SELECT strategy, sell_day, 1000.0 + sum(p) OVER (PARTITION BY strategy ORDER BY sell_day) AS a FROM d), c AS (SELECT strategy, a / lag(a) OVER (PARTITION BY strategy ORDER BY sell_day) - 1 AS c FROM e),
 s AS (SELECT strategy, avg(c) / stddev_samp(c) * sqrt(252.0) AS sharpe FROM c GROUP BY 1), w AS (SELECT strategy, count(*) FILTER (p > 0) / count(*) * 100.0 AS weeks_won FROM (SELECT strategy, (sell_day + 3) // 7 AS week, sum(profit) AS p FROM t GROUP BY 1, 2) GROUP BY 1),
 q AS (SELECT strategy, sell_day, trade_id, 1000.0 + sum(profit) OVER (PARTITION BY strategy ORDER BY sell_day, trade_id) AS q FROM t), m AS (SELECT strategy, max((k - q) / k * 100.0) AS max_drawdown FROM (SELECT strategy, q, greatest(1000.0, max(q) OVER (PARTITION BY strategy ORDER BY sell_day, trade_id)) AS k FROM q) GROUP BY 1),
 f AS (SELECT strategy, count(*) AS n, sum(greatest(profit, 0.0)) / sum(greatest(-profit, 0.0)) AS profit_factor FROM t GROUP BY 1)
 SELECT strategy, n, round(profit_factor, 4) AS profit_factor, round(weeks_won, 4) AS weeks_won, round(sharpe, 3) AS sharpe, round(max_drawdown, 3) AS max_drawdown FROM f JOIN w USING (strategy) JOIN s USING (strategy) JOIN m USING (strategy)""")
def dashboard_metrics(spark, sf_dir):
    return reports.dashboard(trades.trades(spark, sf_dir)).select("strategy", "n", r("profit_factor", 4), r("weeks_won", 4), r("sharpe", 3), r("max_drawdown", 3))


@query(f"SELECT strategy, round((sum(qty * fee * profit) / sum(qty) - sum(qty * fee) * sum(qty * profit) / pow(sum(qty), 2)) / sqrt((sum(qty * fee * fee) / sum(qty) - pow(sum(qty * fee) / sum(qty), 2)) * (sum(qty * profit * profit) / sum(qty) - pow(sum(qty * profit) / sum(qty), 2))), 5) AS corr FROM {T} GROUP BY 1")
def weighted_correlations(spark, sf_dir):
    rows = trades.trades(spark, sf_dir)
    return rows.groupBy("strategy").agg(F.round(reports.weighted_correlation(rows, "fee", "profit", "qty"), 5).alias("corr"))


@query(f"SELECT symbol, arg_max(gap, (n, -gap)) AS step, max(n) AS n FROM (SELECT symbol, gap, count(*) AS n FROM (SELECT symbol, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS gap FROM {H1}) WHERE gap IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def bar_step(spark, sf_dir):
    return reports.bar_step(bars(spark, sf_dir))


@query(f"SELECT symbol, t, slot, volume, CASE WHEN count(volume) OVER w = 5 THEN list_sort(list(volume) OVER w)[3] END AS median FROM (SELECT *, CAST(t % 86400 // 14400 AS BIGINT) AS slot FROM {H1}) WINDOW w AS (PARTITION BY symbol, slot ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def slot_medians(spark, sf_dir):
    return reports.slot_medians(bars(spark, sf_dir), 4, 5)


@query(f"SELECT spec, regexp_replace(lower(spec), '[^a-z0-9]+', '_', 'g') AS slug, n FROM (SELECT string_agg(strategy || '>' || symbol, ' AND ' ORDER BY strategy) AS spec, count(*) AS n FROM (SELECT DISTINCT strategy, symbol FROM {T}) GROUP BY symbol)")
def labels_and_slugs(spark, sf_dir):
    parts = trades.trades(spark, sf_dir).select("strategy", "symbol").distinct()
    rows = parts.groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_list(F.concat("strategy", F.lit(">"), "symbol"))), " AND ").alias("spec"), F.count("*").alias("n"))
    return rows.select("spec", F.regexp_replace(F.lower("spec"), "[^a-z0-9]+", "_").alias("slug"), "n")


@query(f"SELECT trade_id, floor(profit * 100) / 100.0 AS profit_down, floor(qty / 5.0) * 5.0 AS lots FROM {T}")
def rounded_down(spark, sf_dir):
    return trades.trades(spark, sf_dir).select("trade_id", (F.floor(F.col("profit") * 100) / 100.0).alias("profit_down"), (F.floor(F.col("qty") / 5.0) * 5.0).alias("lots"))


#: Thresholds of indicators, crossed with both operators over each indicator's whole grid. Fixed values.
THRESHOLDS = {"rsi": (30.0, 50.0, 70.0), "bb_pctb": (0.2, 0.8), "donchian_pos": (0.3, 0.7), "adx": (20.0, 30.0), "close_pct_rank": (20.0, 80.0), "inside_outside_ratio": (10.0, 30.0), "ret_skew": (-0.5, 0.5)}


def _spec_counts_sql() -> str:
    values = " UNION ALL ".join(f"SELECT '{name}' AS name, '{key}' AS instance, value FROM {indicator_sql(H1, name, params)}" for name in THRESHOLDS for key, params in REGISTRY[name].instances())
    cuts = ", ".join(f"('{name}', '{op}', {th})" for name, ths in THRESHOLDS.items() for th in ths for op in "<>")
    return f"SELECT instance, op, threshold, count(*) AS n FROM ({values}) v JOIN (VALUES {cuts}) c(name, op, threshold) USING (name) WHERE CASE op WHEN '<' THEN value < threshold ELSE value > threshold END GROUP BY 1, 2, 3"


@query(_spec_counts_sql())
def spec_expansion(spark, sf_dir):
    return rules.expanded_counts(bars(spark, sf_dir), THRESHOLDS)


# Walk-forward.
@query(f"{WF_SQL}, s AS (SELECT strategy AS symbol, min(idx) AS first, max(idx) AS last FROM d WHERE NOT (strategy LIKE '2%' AND idx < 300) GROUP BY 1) SELECT symbol, win FROM s JOIN w ON first <= train_from AND last >= test_to - 1")
def wfo_eligible(spark, sf_dir):
    daily, windows = _wf_rows(spark, sf_dir)
    spans = daily.filter(~(F.col("strategy").startswith("2") & (F.col("idx") < 300))).groupBy(F.col("strategy").alias("symbol")).agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    return reports.eligible(spans, windows)


@query(f"{WF_SQL} SELECT win, greatest(test_from - 100, 0) AS bar_from, test_to + 121 AS bar_to FROM w")
def wfo_padded(spark, sf_dir):
    return reports.padded(_wf_rows(spark, sf_dir)[1], 120)


WF_GAINS_SQL = f"""{WF_SQL}, s AS (SELECT win, strategy AS key, sum(CASE WHEN idx < train_to THEN profit ELSE 0 END) / 10.0 AS train, sum(CASE WHEN idx >= test_from THEN profit ELSE 0 END) / 10.0 AS test FROM d JOIN w ON idx >= train_from AND idx < test_to GROUP BY 1, 2)"""


@query(f"""{WF_GAINS_SQL}, a AS (SELECT key, avg(train) AS train, avg(test) AS test FROM s GROUP BY 1), m AS (SELECT strategy AS key, sum(profit) / 10.0 AS net_gain, min(drawdown) AS max_drawdown, regr_r2(equity, n) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY idx) AS n FROM {EQUITY_SQL}) GROUP BY 1),
 v AS (SELECT *, CASE WHEN train > 0 THEN (test / 3.0) / (train / 12.0) ELSE 0.0 END AS wfr FROM a JOIN m USING (key)) SELECT key, round(wfr, 4) AS wfr, round(net_gain, 4) AS net_gain, round(max_drawdown, 4) AS max_drawdown, round(r2, 4) AS r2, coalesce(net_gain >= 10 AND abs(max_drawdown) <= 30 AND r2 >= 0.5 AND wfr >= 0.5, false) AS approved FROM v""")
def wfo_approval(spark, sf_dir):
    daily, windows = _wf_rows(spark, sf_dir)
    rows = daily.join(F.broadcast(windows), (F.col("idx") >= F.col("train_from")) & (F.col("idx") < F.col("test_to")))
    gains = rows.groupBy("win", F.col("strategy").alias("key")).agg(
        (F.sum(F.when(F.col("idx") < F.col("train_to"), F.col("profit")).otherwise(0.0)) / 10.0).alias("train"), (F.sum(F.when(F.col("idx") >= F.col("test_from"), F.col("profit")).otherwise(0.0)) / 10.0).alias("test")
    )
    own = trades.metrics(trades.trades(spark, sf_dir)).select(F.col("strategy").alias("key"), "net_gain", "max_drawdown", "r2")
    return reports.approval(gains, own, 12.0, 3.0).select("key", r("wfr", 4), r("net_gain", 4), r("max_drawdown", 4), r("r2", 4), "approved")


@query(f"""{WF_GAINS_SQL}, b AS (SELECT win, arg_max(key, (train, -ascii(key))) AS key FROM s GROUP BY 1), p AS (SELECT CAST(ascii(key) - 48 AS DOUBLE) * 20 AS param, row_number() OVER (ORDER BY win) AS k, count(*) OVER () AS n FROM b),
 m AS (SELECT sum(param * CASE WHEN k = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - k) END) AS mean FROM p) SELECT round(mean, 6) AS mean, (SELECT arg_min(g, (abs(g - mean), g)) FROM (VALUES (20.0), (40.0), (100.0)) x(g)) AS param FROM m""")
def wfo_params(spark, sf_dir):
    daily, windows = _wf_rows(spark, sf_dir)
    best = walkforward.walk_forward(daily, windows, "strategy").select("win", (F.ascii("strategy") - 48).cast("double").alias("k"))
    out = walkforward.smoothed(best.select("win", (F.col("k") * 20).alias("param")), [20.0, 40.0, 100.0])
    return out.select(r("mean"), "param")
