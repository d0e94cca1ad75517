"""Registered queries and the DuckDB text that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candleforge.operators import etl, exits, rules, screening, stats, trades, walkforward
from candleforge.functions.stretches import in_order, stretched
from candleforge.operators.indicators import REGISTRY, grid_values, indicator_sql, with_indicator
from candleforge.sources.bars import SECONDS, bars, bars_sql, table, ticks
from candleforge.sources.shared import Tables
from candleforge.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = without_negative_zeros(sql)
        return fn

    return register


def without_negative_zeros(sql: str) -> str:
    """``sql`` with 0.0 added to each rounded output column: DuckDB rounds small negative values to -0.0, Spark to 0.0."""
    out, at = [], 0
    while (begin := sql.find("round(", at)) >= 0:
        depth, end = 0, begin + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        out.append(sql[at:end] + (" + 0.0" if sql.startswith(" AS ", end) else ""))
        at = end
    return "".join(out) + sql[at:]


def r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


H1, H4, D1 = bars_sql("1H"), bars_sql("4H"), bars_sql("1D")
#: Bars with faults put in by their time, for the cleaning operators.
FAULTY_SQL = f"(SELECT symbol, t, CASE WHEN t // 3600 % 11 = 0 THEN NULL ELSE open END AS open, high, low, CASE WHEN t // 3600 % 13 = 0 THEN 0.0 ELSE close END AS close, CASE WHEN t // 3600 % 3 = 0 THEN 0.0 WHEN t // 3600 % 5 = 0 THEN NULL ELSE volume END AS volume FROM {H1})"
T = trades.TRADES_SQL
DAILY_SQL = f"""(SELECT s.strategy, s.idx, coalesce(p.profit, 0.0) AS profit FROM (SELECT strategy, unnest(range(min(idx), max(idx) + 1)) AS idx FROM (SELECT strategy, {trades.TRADING_INDEX_SQL} AS idx FROM {T}) GROUP BY strategy) s
 LEFT JOIN (SELECT strategy, {trades.TRADING_INDEX_SQL} AS idx, sum(profit) AS profit FROM {T} GROUP BY 1, 2) p ON s.strategy = p.strategy AND s.idx = p.idx)"""
EQUITY_SQL = f"""(SELECT *, (equity - peak) / peak * 100.0 AS drawdown FROM (SELECT *, greatest(1000.0, max(equity) OVER w) AS peak FROM (SELECT *, 1000.0 + sum(profit) OVER (PARTITION BY strategy ORDER BY idx) AS equity FROM {DAILY_SQL}) WINDOW w AS (PARTITION BY strategy ORDER BY idx)))"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.col("t") / 3600)
    return bars(spark, sf_dir).select(
        "symbol", "t", F.when(hour % 11 != 0, F.col("open")).alias("open"), "high", "low", F.when(hour % 13 == 0, 0.0).otherwise(F.col("close")).alias("close"),
        F.when(hour % 3 == 0, 0.0).when(hour % 5 == 0, None).otherwise(F.col("volume")).alias("volume"),
    )


def _bars_query(name: str, timeframe: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: bars(spark, sf_dir, timeframe)
    ORACLES[name] = f"SELECT * FROM {bars_sql(timeframe)}"


for _tf in SECONDS:
    _bars_query(f"bars_{_tf.lower()}", _tf)


def _indicator_query(name: str) -> None:
    """An indicator over its whole grid: a row for each point, symbol and time."""
    QUERIES[f"ind_{name}"] = lambda spark, sf_dir: grid_values(bars(spark, sf_dir), name).select("instance", "symbol", "t", r("value"))
    ORACLES[f"ind_{name}"] = without_negative_zeros(" UNION ALL ".join(f"SELECT '{key}' AS instance, symbol, t, round(value, 6) AS value FROM {indicator_sql(H1, name, params)}" for key, params in REGISTRY[name].instances()))


for _name in REGISTRY:
    _indicator_query(_name)


@query(f"SELECT symbol, t, open, high, low, close, volume FROM {FAULTY_SQL} WHERE coalesce(open, 0) <> 0 AND coalesce(close, 0) <> 0 AND coalesce(high, 0) <> 0 AND coalesce(low, 0) <> 0")
def clean_prices(spark, sf_dir):
    return etl.drop_bad_prices(faulty(spark, sf_dir))


@query(f"""SELECT symbol, t, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS volume FROM (SELECT symbol, t, nullif(volume, 0) AS v FROM {FAULTY_SQL})""")
def clean_volume(spark, sf_dir):
    return etl.fill_volume(faulty(spark, sf_dir)).select("symbol", "t", "volume")


@query("SELECT symbol, t, arg_min(price, seq) AS price FROM (SELECT event_type AS symbol, CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS t, value AS price, event_id AS seq FROM events) GROUP BY symbol, t")
def clean_duplicates(spark, sf_dir):
    rows = ticks(spark, sf_dir).select("symbol", (F.floor(F.col("us") / 3_600_000_000).cast("long") * 3600).alias("t"), "price", "seq")
    return etl.first_of_each_time(rows, "seq")


EXTREMES_SQL = f"""(SELECT b.*, x.high_time, x.low_time FROM {H4} b JOIN (SELECT symbol, min(t) AS first_t FROM {H1} GROUP BY 1) f ON b.symbol = f.symbol JOIN (SELECT symbol, max(t) AS last_t FROM {H4} GROUP BY 1) l ON b.symbol = l.symbol
 LEFT JOIN (SELECT symbol, t // 14400 * 14400 AS bar, arg_max(t, (high, -t)) AS high_time, arg_min(t, (low, t)) AS low_time FROM {H1} GROUP BY 1, 2) x ON b.symbol = x.symbol AND b.t = x.bar WHERE b.t < l.last_t AND b.t >= f.first_t)"""


def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.intrabar_extremes(bars(spark, sf_dir, "4H"), bars(spark, sf_dir, "1H"), SECONDS["4H"])


@query(f"SELECT symbol, t, high, low, high_time, low_time FROM {EXTREMES_SQL}")
def intrabar_extremes(spark, sf_dir):
    return extremes(spark, sf_dir).select("symbol", "t", "high", "low", "high_time", "low_time")


@query(f"""SELECT symbol, count(*) AS n, count(*) FILTER (high_time < t OR high_time >= t + 14400) AS high_outside, count(*) FILTER (low_time < t OR low_time >= t + 14400) AS low_outside,
 count(*) FILTER (high_time IS NULL) AS unknown FROM {EXTREMES_SQL} GROUP BY symbol""")
def extremes_integrity(spark, sf_dir):
    outside = lambda c: F.count_if((F.col(c) < F.col("t")) | (F.col(c) >= F.col("t") + 14400))
    return extremes(spark, sf_dir).groupBy("symbol").agg(
        F.count("*").alias("n"), outside("high_time").alias("high_outside"), outside("low_time").alias("low_outside"), F.count_if(F.col("high_time").isNull()).alias("unknown")
    )


GAPS_SQL = f"SELECT symbol, lag(t) OVER (PARTITION BY symbol ORDER BY t) AS gap_from, t AS gap_to FROM {H1}"


@query(f"SELECT symbol, gap_from, gap_to, CAST((gap_to - gap_from) // 3600 - 1 AS BIGINT) AS missing FROM ({GAPS_SQL}) WHERE gap_to - gap_from > 5400")
def gap_report(spark, sf_dir):
    return etl.gaps(bars(spark, sf_dir), 3600)


@query(f"SELECT symbol, gap_from, gap_to, CAST((gap_to - gap_from) // 3600 - 1 AS BIGINT) AS missing FROM ({GAPS_SQL}) WHERE gap_to - gap_from > 5400 AND NOT ((gap_from // 86400 + 3) % 7 = 4 AND (gap_to // 86400 + 3) % 7 IN (5, 6, 0))")
def gap_report_forex(spark, sf_dir):
    return etl.gaps(bars(spark, sf_dir), 3600, forex=True)


@query(f"""SELECT symbol, count(*) AS n_bars, count(*) FILTER (open IS NULL) AS null_open, count(*) FILTER (high IS NULL) AS null_high, count(*) FILTER (low IS NULL) AS null_low, count(*) FILTER (close IS NULL) AS null_close,
 count(*) FILTER (volume IS NULL) AS null_volume, count(*) FILTER (coalesce(open = 0, false) OR coalesce(high = 0, false) OR coalesce(low = 0, false) OR coalesce(close = 0, false)) AS zero_price, count(*) FILTER (volume = 0) AS zero_volume,
 count(*) FILTER (low > open OR low > close OR high < open OR high < close) AS incoherent FROM {FAULTY_SQL} GROUP BY symbol""")
def ohlc_integrity(spark, sf_dir):
    return etl.ohlc_integrity(faulty(spark, sf_dir))


@query(f"""SELECT s.symbol, timeframe, first_t, last_t, first_t - d0 > 432000 AS late_start, abs(last_t - d1) > 432000 AS end_differs FROM (
 SELECT symbol, '1H' AS timeframe, min(t) AS first_t, max(t) AS last_t FROM {H1} GROUP BY 1 UNION ALL SELECT symbol, '4H', min(t), max(t) FROM {H4} GROUP BY 1 UNION ALL SELECT symbol, '1D', min(t), max(t) FROM {D1} GROUP BY 1) s
 JOIN (SELECT symbol, min(t) AS d0, max(t) AS d1 FROM {D1} GROUP BY 1) d ON s.symbol = d.symbol""")
def coverage(spark, sf_dir):
    return etl.coverage({tf: bars(spark, sf_dir, tf) for tf in ("1H", "4H", "1D")})


@query(f"""SELECT symbol, t, CASE WHEN t < epoch(DATE '2024-01-25' - INTERVAL 1 MONTH)::BIGINT THEN 'IS' ELSE 'OOS' END AS sample FROM {H4} WHERE t >= epoch(DATE '2023-12-01')::BIGINT AND t < epoch(DATE '2024-01-25')::BIGINT""")
def split_is_oos(spark, sf_dir):
    return etl.split_in_out(bars(spark, sf_dir, "4H"), "2023-12-01", "2024-01-25", 1).select("symbol", "t", "sample")


@query(f"SELECT b.symbol, b.t, b.close FROM {H4} b WHERE symbol IN (SELECT symbol FROM {D1} GROUP BY symbol HAVING count(*) >= 30)")
def min_history(spark, sf_dir):
    return etl.long_histories(bars(spark, sf_dir, "4H"), bars(spark, sf_dir, "1D"), 30).select("symbol", "t", "close")


REBUILT_SQL = f"(SELECT symbol, CAST((t - 14400) // 21600 * 21600 + 14400 AS BIGINT) AS bar, arg_min(open, t) AS open, max(high) AS high, min(low) AS low, arg_max(close, t) AS close FROM {H1} GROUP BY 1, 2 HAVING count(*) = 6)"


@query(f"SELECT symbol, bar AS t, open, high, low, close FROM {REBUILT_SQL}")
def bars_rebuild_offset(spark, sf_dir):
    return etl.rebuild(bars(spark, sf_dir), 3600, 21_600, 14_400).select("symbol", "t", "open", "high", "low", "close")


@query(f"""SELECT o.symbol, o.t, CASE WHEN n.open IS NULL THEN 'NO_1H' WHEN o.high = o.low THEN 'FLAT' WHEN w <= 1e-4 THEN 'OK' ELSE 'DIFF' END AS status FROM {H4} o
 LEFT JOIN (SELECT symbol, t // 14400 * 14400 AS t, arg_min(open, t) AS open, max(high) AS high, min(low) AS low, arg_max(close, t) AS close FROM {H1} GROUP BY 1, 2 HAVING count(*) = 4) n ON o.symbol = n.symbol AND o.t = n.t,
 LATERAL (SELECT greatest(abs(o.open - n.open) / nullif(abs(o.open), 0), abs(o.high - n.high) / nullif(abs(o.high), 0), abs(o.low - n.low) / nullif(abs(o.low), 0), abs(o.close - n.close) / nullif(abs(o.close), 0)) AS w) x""")
def bar_comparison(spark, sf_dir):
    return etl.compare_bars(bars(spark, sf_dir, "4H"), etl.rebuild(bars(spark, sf_dir), 3600, 14_400)).select("symbol", "t", "status")


@query(f"SELECT t FROM {H1} GROUP BY t HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM {H1})")
def universe_alignment(spark, sf_dir):
    return etl.common_times(bars(spark, sf_dir))


@query(f"SELECT t, dense_rank() OVER (ORDER BY t) - 1 AS position FROM (SELECT DISTINCT t FROM {H1})")
def global_timeline(spark, sf_dir):
    return etl.timeline(bars(spark, sf_dir))


@query(f"SELECT symbol, round(avg(volume * close), 6) AS mean_volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS k FROM {D1}) WHERE k <= 20 GROUP BY symbol ORDER BY avg(volume * close) DESC, symbol LIMIT 3")
def top_volume(spark, sf_dir):
    return etl.top_by_volume(bars(spark, sf_dir, "1D"), 20, 3).select("symbol", r("mean_volume"))


@query(f"""SELECT symbol, min(d) AS decimals FROM (SELECT symbol, d, bool_and(abs(close * pow(10.0, d) - round_even(close * pow(10.0, d), 0)) < 1e-6 * greatest(1.0, abs(close * pow(10.0, d)))) AS fits FROM {H1}, range(9) g(d) GROUP BY 1, 2) WHERE fits GROUP BY symbol""")
def price_decimals(spark, sf_dir):
    return etl.price_decimals(bars(spark, sf_dir))


@query(f"""SELECT symbol, stretch, n, n < 0.9 * 240 AS sparse FROM (SELECT symbol, t // 864000 AS stretch, count(*) AS n, min(t // 864000) OVER w AS a, max(t // 864000) OVER w AS b FROM {H1} GROUP BY 1, 2 WINDOW w AS (PARTITION BY symbol)) WHERE stretch > a AND stretch < b""")
def history_density(spark, sf_dir):
    return etl.density(bars(spark, sf_dir), 24)


@query("""SELECT user_id AS position_id, min(epoch_us(ts)) FILTER (event_type = 'signup') AS open_us, max(epoch_us(ts)) FILTER (event_type = 'purchase') AS close_us, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS profit,
 CASE WHEN max(epoch_us(ts)) FILTER (event_type = 'purchase') IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id HAVING min(epoch_us(ts)) FILTER (event_type = 'signup') IS NOT NULL""")
def deals_to_trades(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type IN ('signup', 'purchase')")
    entry = F.when(F.col("event_type") == "signup", "in").otherwise("out")
    deals = rows.select(F.col("user_id").alias("position_id"), entry.alias("entry"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("profit"))
    return etl.deals_to_trades(deals).select("position_id", "open_us", "close_us", r("profit", 4), "status")


# Conditions and rules.
def _spec_sql(shift: bool) -> str:
    parts = []
    for i, (name, params, op, threshold) in enumerate(rules.SPECS):
        met = f"coalesce(value {op} {threshold}, false)"
        if shift:
            met = f"coalesce(lag({met}) OVER (PARTITION BY symbol ORDER BY t), false)"
        parts.append(f"SELECT {i} AS spec_id, symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) AS bar, {met} AS met FROM {indicator_sql(H1, name, params)}")
    return f"(SELECT CAST(spec_id AS BIGINT) AS spec_id, symbol, t, bar FROM ({' UNION ALL '.join(parts)}) WHERE met)"


HITS_SQL = _spec_sql(True)
_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT {2 * k + s} AS rule_id, {i} AS spec_id, {len(ids)} AS need"
    for k, ids in enumerate(rules.spec_sets())
    for i in ids
    for s in (0, 1)
)


@query(f"SELECT * FROM {HITS_SQL}")
def rule_hits(spark, sf_dir):
    return rules.hits(bars(spark, sf_dir))


@query(f"SELECT CAST(rule_id AS BIGINT) AS rule_id, h.symbol, h.t, h.bar FROM {HITS_SQL} h JOIN ({_PAIRS_SQL}) p ON h.spec_id = p.spec_id GROUP BY ALL HAVING count(*) = max(need)")
def rule_events(spark, sf_dir):
    return rules.events(rules.rules(spark), rules.hits(bars(spark, sf_dir)))


@query(f"SELECT spec_id, symbol, bar // 64 AS word, CAST(count(*) AS INT) AS n_set, min(bar % 64) AS low_bit FROM {HITS_SQL} GROUP BY ALL")
def rule_words(spark, sf_dir):
    low = F.expr("aggregate(sequence(63, 0), 64L, (s, i) -> IF(getbit(bits, i) = 1, CAST(i AS BIGINT), s))")
    return rules.words(rules.hits(bars(spark, sf_dir))).select("spec_id", "symbol", "word", F.bit_count("bits").alias("n_set"), low.alias("low_bit"))


@query(f"""SELECT a, b, round(n / (na + nb - n), 6) AS jaccard FROM (SELECT x.spec_id AS a, y.spec_id AS b, count(*) AS n FROM {HITS_SQL} x JOIN {HITS_SQL} y ON x.symbol = y.symbol AND x.t = y.t AND x.spec_id < y.spec_id GROUP BY 1, 2)
 JOIN (SELECT spec_id AS a, count(*) AS na FROM {HITS_SQL} GROUP BY 1) USING (a) JOIN (SELECT spec_id AS b, count(*) AS nb FROM {HITS_SQL} GROUP BY 1) USING (b)""")
def jaccard_pairs(spark, sf_dir):
    return rules.jaccard(rules.words(rules.hits(bars(spark, sf_dir)))).filter("jaccard > 0").select("a", "b", r("jaccard"))


# Exits.
@query(f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar FROM {EXTREMES_SQL}), n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1),
 hit AS (SELECT e.symbol, e.t, e.bar, e.close AS c0, min(f.bar) AS hit_bar FROM b e JOIN n USING (symbol) LEFT JOIN b f ON e.symbol = f.symbol AND f.bar > e.bar AND f.bar <= e.bar + 10 AND (f.high >= e.close * 1.3 OR f.low <= e.close * 0.7) WHERE e.bar + 10 < n.n AND e.close > 0 GROUP BY 1, 2, 3, 4),
 res AS (SELECT h.symbol, h.t, h.bar, CASE WHEN hit_bar IS NULL THEN 'TIME' WHEN f.high >= c0 * 1.3 AND (f.low > c0 * 0.7 OR coalesce(f.high_time < f.low_time, false)) THEN 'TP' ELSE 'SL' END AS kind, coalesce(hit_bar, h.bar + 10) AS exit_bar, (z.close / c0 - 1) * 100 AS drift
 FROM hit h LEFT JOIN b f ON h.symbol = f.symbol AND f.bar = h.hit_bar JOIN b z ON z.symbol = h.symbol AND z.bar = h.bar + 10)
 SELECT symbol, t, bar, kind, exit_bar, round(g - 0.005 * (2 + g / 100.0), 6) AS y FROM (SELECT *, CASE kind WHEN 'TP' THEN 30.0 WHEN 'SL' THEN -30.0 ELSE drift END AS g FROM res)""")
def first_touch_targets(spark, sf_dir):
    return exits.targets(extremes(spark, sf_dir), 10, 30.0, 30.0).select("symbol", "t", "bar", "kind", "exit_bar", r("y"))


def _simulated(spark, sf_dir, pyramid: bool) -> DataFrame:
    rows = extremes(spark, sf_dir)
    found = rules.events(rules.rules(spark).filter("side = 'LONG'"), rules.hits(rows))
    return exits.simulate(found, exits.entries(rows, 10, 30.0, 30.0), pyramid)


@query()
def sim_no_pyramid(spark, sf_dir):
    return _simulated(spark, sf_dir, False)


@query()
def sim_pyramid(spark, sf_dir):
    return _simulated(spark, sf_dir, True)


# Screening.
def _gains(rows: DataFrame, horizon: int = 5) -> DataFrame:
    """``rows`` with ``y``, the change of the close over the next bars."""
    return stretched(rows, ahead=horizon).withColumn("y", F.lead("close", horizon).over(in_order()) - F.col("close")).filter("_own")


@query(f"""WITH v AS (SELECT a.value, c.y FROM {indicator_sql(H1, 'bb_pctb', {'n': 20})} a JOIN (SELECT symbol, t, (lead(close, 5) OVER (PARTITION BY symbol ORDER BY t) - close) AS y FROM {H1}) c USING (symbol, t) WHERE value IS NOT NULL AND y IS NOT NULL),
 e AS (SELECT count(*) AS an, avg(y) AS am, stddev_pop(y) AS asd FROM v), s AS (SELECT CAST(k AS BIGINT) AS cut, side, y FROM v, (VALUES (0, 0.2), (1, 0.5), (2, 0.8)) c(k, th), (VALUES ('<'), ('>')) d(side) WHERE CASE WHEN side = '<' THEN value < th ELSE value > th END)
 SELECT cut, side, count(*) AS n, round(avg(y), 6) AS mean, round(avg(y) - any_value(am), 6) AS excess, round((avg(y) - any_value(am)) / (greatest(stddev_pop(y), any_value(asd)) / sqrt(count(*))), 6) AS z FROM s, e GROUP BY cut, side HAVING count(*) >= 30 AND any_value(an) - count(*) >= 30""")
def segment_edges(spark, sf_dir):
    rows = _gains(with_indicator(bars(spark, sf_dir), "bb_pctb", {"n": 20}))
    out = screening.segment_edges(rows.select("value", "y"), [0.2, 0.5, 0.8])
    return out.select("cut", "side", F.col("n").cast("long").alias("n"), r("mean"), r("excess"), r("z"))


@query(f"""WITH v AS (SELECT a.value AS a, b.value AS b, c.y FROM {indicator_sql(H1, 'bb_pctb', {'n': 20})} a JOIN {indicator_sql(H1, 'rsi', {'period': 14})} b USING (symbol, t) JOIN (SELECT symbol, t, (lead(close, 5) OVER (PARTITION BY symbol ORDER BY t) - close) AS y FROM {H1}) c USING (symbol, t)
 WHERE a.value IS NOT NULL AND b.value IS NOT NULL AND y IS NOT NULL), k AS (SELECT 2 * (a > 0.2)::INT + (a = 0.2)::INT + 2 * (a > 0.8)::INT + (a = 0.8)::INT AS i, 2 * (b > 45)::INT + (b = 45)::INT + 2 * (b > 55)::INT + (b = 55)::INT AS j, y FROM v)
 SELECT g.i, h.j, count(y) AS n, round(coalesce(sum(y), 0), 4) AS s FROM range(5) g(i) CROSS JOIN range(5) h(j) LEFT JOIN k ON k.i <= g.i AND k.j <= h.j GROUP BY 1, 2""")
def pair_rectangles(spark, sf_dir):
    rows = with_indicator(bars(spark, sf_dir), "bb_pctb", {"n": 20}, "a")
    rows = _gains(with_indicator(rows, "rsi", {"period": 14}, "b"))
    return screening.pair_table(rows.select("a", "b", "y"), [0.2, 0.8], [45.0, 55.0]).select("i", "j", "n", r("s", 4))


# Trades.
def _daily(spark, sf_dir) -> DataFrame:
    """The daily profits, at most a row for each strategy and day, stored so that lines and orders are joined once."""
    return Tables(spark).kept(trades.daily_profit(trades.trades(spark, sf_dir)))


@query(f"SELECT strategy, idx, round(profit, 8) AS profit FROM {DAILY_SQL}")
def daily_profit(spark, sf_dir):
    return _daily(spark, sf_dir).select("strategy", "idx", r("profit", 8))


@query(f"SELECT strategy, idx, round(equity, 8) AS equity, round(drawdown, 4) AS drawdown FROM {EQUITY_SQL}")
def equity_drawdown(spark, sf_dir):
    return trades.equity(_daily(spark, sf_dir)).select("strategy", "idx", r("equity", 8), r("drawdown", 4))


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY idx) AS n FROM {EQUITY_SQL}), m AS (SELECT strategy, avg(profit) AS mu FROM e GROUP BY 1),
 d AS (SELECT strategy, count(*) AS n_days, avg(profit) AS mean, stddev_pop(profit) AS std, min(drawdown) AS max_drawdown, sum(profit) / 10.0 AS net_gain, avg(pow(profit - mu, 3)) AS m3, avg(pow(profit - mu, 4)) AS m4, regr_r2(equity, n) AS r2 FROM e JOIN m USING (strategy) GROUP BY 1),
 t AS (SELECT strategy, count(*) AS n_trades, count(*) FILTER (profit > 0) / count(*) * 100.0 AS win_rate, sum(greatest(profit, 0.0)) AS won, sum(greatest(-profit, 0.0)) AS lost FROM {T} GROUP BY 1)
 SELECT strategy, n_days, n_trades, round(net_gain, 4) AS net_gain, round(max_drawdown, 4) AS max_drawdown, round(mean / std * sqrt(252.0), 4) AS sharpe, round(m3 / pow(std, 3), 4) AS skew, round(m4 / pow(std, 4), 4) AS kurtosis, round(r2, 4) AS r2,
 round(win_rate, 4) AS win_rate, round(won / lost, 4) AS profit_factor, round(CASE WHEN max_drawdown < 0 THEN net_gain / -max_drawdown END, 4) AS calmar FROM d JOIN t USING (strategy)""")
def strategy_metrics(spark, sf_dir):
    out = trades.metrics(trades.trades(spark, sf_dir))
    return out.select("strategy", "n_days", "n_trades", *[r(c, 4) for c in out.columns[3:]])


@query(f"""WITH w AS (SELECT strategy, CAST(floor(idx / 5.0) AS BIGINT) AS week, arg_max(equity, idx) AS equity FROM {EQUITY_SQL} GROUP BY 1, 2), p AS (SELECT *, lag(equity, 1, 1000.0) OVER o AS before, greatest(1000.0, max(equity) OVER o) AS peak, min(week) OVER (PARTITION BY strategy) AS w0 FROM w WINDOW o AS (PARTITION BY strategy ORDER BY week))
 SELECT strategy, week, round(equity, 8) AS equity, round(CASE WHEN before > 0 THEN (equity / before - 1) * 100 END, 4) AS change, week - coalesce(max(CASE WHEN equity >= peak THEN week END) OVER (PARTITION BY strategy ORDER BY week), w0 - 1) AS weeks_below FROM p""")
def weekly_equity(spark, sf_dir):
    return trades.weeks(_daily(spark, sf_dir)).select("strategy", "week", r("equity", 8), r("change", 4), "weeks_below")


@query(f"""WITH s AS (SELECT strategy, count(*) AS n_trades, sum(profit) AS profit, count(*) FILTER (profit > 0) / count(*) * 100.0 AS pct_positive, coalesce(sum(profit) FILTER (profit > 0), 0) AS won, coalesce(sum(profit) FILTER (profit < 0), 0) AS lost,
 count(*) FILTER (exit_reason = 'TP') / count(*) * 100.0 AS pct_tp, count(*) FILTER (exit_reason = 'SL') / count(*) * 100.0 AS pct_sl, count(*) FILTER (exit_reason = 'SELL_AFTER') / count(*) * 100.0 AS pct_sell_after, avg(sell_day - buy_day) AS mean_days, min(buy_day) AS first_open FROM {T} GROUP BY 1)
 SELECT strategy, n_trades, round(profit, 4) AS profit, round(pct_positive, 4) AS pct_positive, round(pct_tp, 4) AS pct_tp, round(pct_sl, 4) AS pct_sl, round(pct_sell_after, 4) AS pct_sell_after, round(mean_days, 4) AS mean_days, first_open, round(won / sum(won) OVER () * 100, 4) AS won_share, round(lost / sum(lost) OVER () * 100, 4) AS lost_share FROM s""")
def strategy_report(spark, sf_dir):
    out = trades.strategy_report(trades.trades(spark, sf_dir))
    return out.select(*[c if c in ("strategy", "n_trades", "first_open") else r(c, 4) for c in out.columns])


@query(f"""SELECT coalesce(strategy, side, 'Combined') AS curve, count(*) AS n_trades, round(sum(profit), 4) AS profit, count(*) FILTER (profit > 0) AS n_won FROM {T} GROUP BY GROUPING SETS ((strategy), (side), ())""")
def curves_table(spark, sf_dir):
    return trades.curves(trades.trades(spark, sf_dir)).select("curve", "n_trades", r("profit", 4), "n_won")


@query("""WITH e AS (SELECT event_type AS symbol, epoch_us(ts) AS us, event_id AS id FROM events), g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 1800000000 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY symbol ORDER BY us, id)),
 n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY symbol ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS round FROM g) SELECT symbol, round, min(us) AS from_us, max(us) AS to_us, count(*) AS n FROM n GROUP BY 1, 2""")
def rounds_sessions(spark, sf_dir):
    return trades.rounds(ticks(spark, sf_dir).select("symbol", "us", F.col("seq").alias("id")), 1_800_000_000)


RANKED_SQL = f"(SELECT symbol || side AS id, side AS grp, row_number() OVER (ORDER BY sum(profit) DESC, symbol || side) AS rank FROM {T} GROUP BY symbol, side)"


@query(f"SELECT id, grp, rank, turn FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY grp) AS g FROM {RANKED_SQL}) ORDER BY turn, g LIMIT 5")
def round_robin_cap(spark, sf_dir):
    sums = trades.trades(spark, sf_dir).groupBy("symbol", "side").agg(F.sum("profit").alias("p")).select(F.concat("symbol", "side").alias("id"), F.col("side").alias("grp"), "p")
    ranked = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("p"), "id")).cast("long"))
    return trades.round_robin(ranked.select("id", "grp", "rank"), 5)


@query(f"""WITH d AS (SELECT strategy, idx, profit FROM {DAILY_SQL}), i AS (SELECT DISTINCT idx FROM d), s AS (SELECT DISTINCT strategy FROM d), f AS (SELECT s.strategy, i.idx, coalesce(d.profit, 0) AS profit FROM s CROSS JOIN i LEFT JOIN d ON d.strategy = s.strategy AND d.idx = i.idx)
 SELECT x.strategy AS a, y.strategy AS b, round(corr(x.profit, y.profit), 6) AS corr FROM f x JOIN f y ON x.idx = y.idx AND x.strategy < y.strategy GROUP BY 1, 2""")
def corr_pairs(spark, sf_dir):
    return trades.correlations(_daily(spark, sf_dir)).select("a", "b", r("corr"))


@query(f"""SELECT symbol, n, wins, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS wilson FROM (SELECT symbol, count(*) AS n, count(*) FILTER (profit > 0) AS wins, count(*) FILTER (profit > 0) / count(*) AS p FROM {T} GROUP BY 1)""")
def wilson_bounds(spark, sf_dir):
    sums = trades.trades(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("profit") > 0).alias("wins"))
    return sums.select("symbol", "n", "wins", F.round(trades.wilson_lower(F.col("wins"), F.col("n")), 6).alias("wilson"))


@query(f"""SELECT strategy, count(*) AS n, round(avg(profit), 6) AS mean_profit, round(avg(fee) FILTER (exit_reason = 'TP'), 6) AS fee_tp, round(avg(fee) FILTER (exit_reason = 'SL'), 6) AS fee_sl, CASE WHEN avg(fee) > 0.045 THEN 'HIGH' WHEN avg(fee) > 0.035 THEN 'MEDIUM' ELSE 'LOW' END AS band
 FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY sell_day DESC, trade_id DESC) AS k FROM {T}) WHERE k <= 100 GROUP BY 1""")
def execution_quality(spark, sf_dir):
    rows = trades.last_of_each(trades.trades(spark, sf_dir), 100)
    of = lambda reason: F.round(F.avg(F.when(F.col("exit_reason") == reason, F.col("fee"))), 6)
    band = F.when(F.avg("fee") > 0.045, "HIGH").when(F.avg("fee") > 0.035, "MEDIUM").otherwise("LOW")
    return rows.groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.avg("profit"), 6).alias("mean_profit"), of("TP").alias("fee_tp"), of("SL").alias("fee_sl"), band.alias("band"))


@query(f"""SELECT round((l + s) / b * 100, 6) AS gross, round((l - s) / b * 100, 6) AS net, round(l / b * 100, 6) AS long, round(s / b * 100, 6) AS short FROM (SELECT coalesce(sum(qty) FILTER (buy_day <= 10000 AND sell_day > 10000 AND side = 'LONG'), 0) AS l,
 coalesce(sum(qty) FILTER (buy_day <= 10000 AND sell_day > 10000 AND side = 'SHORT'), 0) AS s, 1000000.0 + coalesce(sum(profit) FILTER (sell_day <= 10000), 0) AS b FROM {T})""")
def exposure(spark, sf_dir):
    return trades.exposure(trades.trades(spark, sf_dir), 10_000, 1_000_000.0).select(*[r(c) for c in ("gross", "net", "long", "short")])


@query(f"SELECT strategy, round(sum(fee * qty) / sum(qty), 6) AS rate, round(sum(fee * qty), 4) AS fees, round(sum(qty), 4) AS notional FROM {T} GROUP BY 1")
def fee_rates(spark, sf_dir):
    notional, fees = F.sum("qty"), F.sum(F.col("fee") * F.col("qty"))
    return trades.trades(spark, sf_dir).groupBy("strategy").agg(F.round(fees / notional, 6).alias("rate"), F.round(fees, 4).alias("fees"), F.round(notional, 4).alias("notional"))


@query(f"SELECT sell_day, count(*) AS n, round(count(*) FILTER (profit > 0) / count(*) * 100.0, 4) AS win_rate FROM {T} GROUP BY 1")
def daily_win_rate(spark, sf_dir):
    return trades.trades(spark, sf_dir).groupBy("sell_day").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("profit") > 0) / F.count("*") * 100.0, 4).alias("win_rate"))


@query(f"SELECT symbol, arg_max(strategy, (profit, strategy)) AS best, round(max(profit), 4) AS profit FROM (SELECT symbol, strategy, sum(profit) AS profit FROM {T} GROUP BY 1, 2) GROUP BY symbol")
def best_by_group(spark, sf_dir):
    sums = trades.trades(spark, sf_dir).groupBy("symbol", "strategy").agg(F.sum("profit").alias("p"))
    return sums.groupBy("symbol").agg(F.max_by("strategy", F.struct("p", "strategy")).alias("best"), F.round(F.max("p"), 4).alias("profit"))


@query(f"SELECT symbol, round(quantile_cont(profit, 0.1), 6) AS p10, round(quantile_cont(profit, 0.5), 6) AS p50, round(quantile_cont(profit, 0.9), 6) AS p90 FROM {T} GROUP BY 1")
def profit_percentiles(spark, sf_dir):
    q = F.percentile("profit", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    sums = trades.trades(spark, sf_dir).groupBy("symbol").agg(q.alias("q"))
    return sums.select("symbol", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("p10", "p50", "p90"))])


# Joins of event streams.
@query("""SELECT p.event_id AS purchase_id, max(c.event_id) AS click_id FROM events p JOIN events c ON p.user_id = c.user_id AND c.event_type = 'click' AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 1 DAY WHERE p.event_type = 'purchase' GROUP BY 1""")
def interval_match(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    p, c = e.filter("event_type = 'purchase'").alias("p"), e.filter("event_type = 'click'").alias("c")
    both = p.join(c, (F.col("p.user_id") == F.col("c.user_id")) & (F.col("c.us") <= F.col("p.us")) & (F.col("c.us") >= F.col("p.us") - 86_400_000_000))
    return both.groupBy(F.col("p.event_id").alias("purchase_id")).agg(F.max("c.event_id").alias("click_id"))


@query("""SELECT p.event_id AS purchase_id, arg_min(c.event_id, (abs(epoch_us(c.ts) - epoch_us(p.ts)), c.event_id)) AS nearest_id, min(abs(epoch_us(c.ts) - epoch_us(p.ts))) AS distance_us FROM events p JOIN events c ON p.user_id = c.user_id AND c.event_type = 'view' WHERE p.event_type = 'purchase' GROUP BY 1""")
def nearest_match(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    p, c = e.filter("event_type = 'purchase'").alias("p"), e.filter("event_type = 'view'").alias("c")
    gap = F.abs(F.col("c.us") - F.col("p.us"))
    both = p.join(c, F.col("p.user_id") == F.col("c.user_id"))
    return both.groupBy(F.col("p.event_id").alias("purchase_id")).agg(F.min_by("c.event_id", F.struct(gap, "c.event_id")).alias("nearest_id"), F.min(gap).alias("distance_us"))


# Walk-forward and portfolios.
def _wf_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    daily = _daily(spark, sf_dir)
    first, last = daily.agg(F.min("idx"), F.max("idx")).first()
    return daily.withColumn("idx", F.col("idx") - first), walkforward.windows_table(spark, last - first + 1, 250, 60)


WF_SQL = f"""WITH d AS (SELECT strategy, idx - min(idx) OVER () AS idx, profit FROM {DAILY_SQL}), n AS (SELECT max(idx) + 1 AS n FROM d), w AS (SELECT CAST(k AS BIGINT) AS win, (n - 250) % 60 + 60 * k AS train_from, (n - 250) % 60 + 60 * k + 250 AS train_to, (n - 250) % 60 + 60 * k + 250 AS test_from,
 (n - 250) % 60 + 60 * k + 310 AS test_to FROM n, range(100) g(k) WHERE (n - 250) % 60 + 60 * k + 310 <= n)"""


@query(f"{WF_SQL} SELECT * FROM w")
def wfo_windows(spark, sf_dir):
    return _wf_rows(spark, sf_dir)[1]


@query(f"""{WF_SQL}, s AS (SELECT win, strategy, sum(CASE WHEN idx < train_to THEN profit ELSE 0 END) AS train, sum(CASE WHEN idx >= test_from THEN profit ELSE 0 END) AS test FROM d JOIN w ON idx >= train_from AND idx < test_to GROUP BY 1, 2)
 SELECT win, strategy, round(train, 4) AS train, round(test, 4) AS test FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY train DESC, strategy) AS k FROM s) WHERE k = 1""")
def wfo_test(spark, sf_dir):
    return walkforward.walk_forward(*_wf_rows(spark, sf_dir), "strategy").select("win", "strategy", r("train", 4), r("test", 4))


@query(f"""WITH RECURSIVE d AS (SELECT strategy, idx, profit FROM {DAILY_SQL}), s AS (SELECT strategy, CAST(row_number() OVER (ORDER BY sum(profit) DESC, strategy) - 1 AS BIGINT) AS idx FROM d GROUP BY 1 ORDER BY sum(profit) DESC, strategy LIMIT 25),
 c AS (SELECT CAST(pow(2, idx) AS BIGINT) AS combo, idx AS last, [strategy] AS members FROM s UNION ALL SELECT c.combo + CAST(pow(2, s.idx) AS BIGINT), s.idx, list_append(c.members, s.strategy) FROM c JOIN s ON s.idx > c.last WHERE len(c.members) < 8),
 m AS (SELECT combo, len(members) AS k, unnest(members) AS strategy FROM c WHERE len(members) >= 2), y AS (SELECT combo, k, idx, sum(profit) AS profit FROM m JOIN d USING (strategy) GROUP BY 1, 2, 3),
 e AS (SELECT *, k * 1000.0 + sum(profit) OVER (PARTITION BY combo ORDER BY idx) AS equity, row_number() OVER (PARTITION BY combo ORDER BY idx) AS n FROM y), p AS (SELECT *, greatest(k * 1000.0, max(equity) OVER (PARTITION BY combo ORDER BY idx)) AS peak FROM e),
 x AS (SELECT combo, sum(profit) / max(k * 1000.0) * 100.0 AS net_gain, min((equity - peak) / peak * 100.0) AS max_drawdown, regr_r2(equity, n) AS r2 FROM p GROUP BY 1)
 SELECT combo, round(net_gain, 4) AS net_gain, round(max_drawdown, 4) AS max_drawdown, round(r2, 4) AS r2, round(CASE WHEN max_drawdown < 0 THEN net_gain / -max_drawdown END, 4) AS calmar, rank FROM (SELECT *, (row_number() OVER (ORDER BY net_gain DESC, combo) + row_number() OVER (ORDER BY max_drawdown DESC, combo)) / 2.0 AS rank FROM x) ORDER BY rank, combo LIMIT 3""")
def portfolio_rank(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    gains = daily.groupBy("strategy").agg(F.sum("profit").alias("gain")).orderBy(F.desc("gain"), "strategy").limit(25)
    ids = gains.select("strategy", (F.row_number().over(Window.orderBy(F.desc("gain"), "strategy")) - 1).cast("long").alias("idx"))
    out = walkforward.ranked(walkforward.score(walkforward.portfolios(ids), daily), 3)
    return out.select("combo", *[r(c, 4) for c in ("net_gain", "max_drawdown", "r2", "calmar")], "rank")


# Resampling.
def _columns(spark, sf_dir) -> DataFrame:
    daily = _daily(spark, sf_dir)
    first, last = daily.agg(F.min("idx"), F.max("idx")).first()
    return stats.sharpe_deviations(daily, "strategy", int(last - first + 1), int(first))


@query()
def stepm_pvalues(spark, sf_dir):
    return stats.step_down(_columns(spark, sf_dir), "strategy").select("strategy", r("z"), r("p"))


@query()
def white_reality_check(spark, sf_dir):
    return stats.reality_check(_columns(spark, sf_dir))


# Streams.
def _stream_dir(spark: SparkSession) -> str:
    """A new folder for a stream's state, where all executors reach it; a folder of this machine in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-stream-")
    return f"{path}/{uuid.uuid4().hex}"


@query(f"SELECT symbol, t, open, high, low, close, CAST(volume AS BIGINT) AS n FROM {H4} WHERE (t + 14400) * 1000000 <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000")
def stream_closed_bars(spark, sf_dir):
    return live.drain(live.closed_bars(live.tick_stream(spark, sf_dir, "events.parquet"), "4 hours", "1 hour"), "bars", _stream_dir(spark))


@query()
def stream_monitor(spark, sf_dir):
    return live.drain(live.monitor(live.tick_stream(spark, sf_dir, "events.parquet"), 30.0, 30.0, 20), "positions", _stream_dir(spark))
