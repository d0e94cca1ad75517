"""Registered research queries: multiple testing, selections, walks, recursions and screening, with DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.functions import recurrence
from candleforge.functions.stretches import in_order, stretched
from candleforge.operators import etl, exits, matching, multiple_testing, multiverse, null_screen, rules, selection, stats
from candleforge.operators.indicators import REGISTRY, indicator_sql, with_indicator
from candleforge.plans.catalog import EXTREMES_SQL, H1, HITS_SQL, ORACLES, extremes, query, r
from candleforge.sources.bars import bars, bars_sql, table

# Multiple testing. A column is a supplier, its profit a day what its lines give over a margin; every tenth is better.
BLOCK, REPLICAS, ALPHA, GAMMA = 10, stats.REPLICAS, multiple_testing.ALPHA, multiple_testing.GAMMA


def supplier_daily(spark, sf_dir) -> DataFrame:
    """(col, idx, profit) of days with lines; idx is the epoch day."""
    lines = table(spark, sf_dir, "lineitem")
    better = F.when(F.col("l_suppkey") % 10 == 0, 0.012).otherwise(0.0)
    gain = F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax") - 0.01 + better) / 1000.0
    return lines.groupBy(F.col("l_suppkey").alias("col"), F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("idx")).agg(F.sum(gain).alias("profit"))


def supplier_columns(spark, sf_dir) -> DataFrame:
    daily = supplier_daily(spark, sf_dir)
    first, last = daily.agg(F.min("idx"), F.max("idx")).first()
    return stats.sharpe_deviations(daily, "col", int(last - first + 1), int(first), BLOCK, REPLICAS, multiple_testing.hash_weights)


SUPPLIER_DAILY_SQL = """(SELECT l_suppkey AS col, CAST(epoch_us(l_shipdate) // 86400000000 AS BIGINT) AS idx,
 sum(l_extendedprice * (l_discount - l_tax - 0.01 + CASE WHEN l_suppkey % 10 = 0 THEN 0.012 ELSE 0.0 END) / 1000.0) AS profit FROM lineitem GROUP BY 1, 2)"""

#: Columns ``c`` (col, z, place) and deviations ``v`` (place, r, d) of the same test, for use after WITH RECURSIVE.
DEVIATIONS_SQL = f"""p AS MATERIALIZED (SELECT * FROM {SUPPLIER_DAILY_SQL}), span AS (SELECT min(idx) AS first, max(idx) - min(idx) + 1 AS days FROM p),
 starts AS (SELECT r, k, CAST('0x' || substr(md5('42:' || r || ':' || k), 1, 8) AS BIGINT) % (days - {BLOCK} + 1) AS s, days
  FROM span, range({REPLICAS}) a(r), LATERAL (SELECT unnest(range(CAST(ceil(days / {BLOCK}.0) AS BIGINT))) AS k)),
 w AS MATERIALIZED (SELECT r, s + j AS day, count(*) AS w FROM starts, range({BLOCK}) b(j) WHERE k * {BLOCK} + j < days GROUP BY 1, 2),
 boot AS (SELECT col, r, sum(w * profit) / any_value(days) AS m, sum(w * profit * profit) / any_value(days) AS q, any_value(days) AS days
  FROM p, span, w WHERE p.idx - first = w.day GROUP BY 1, 2),
 own AS (SELECT col, m / sqrt((q - m * m) * days / (days - 1.0)) AS own FROM (SELECT col, sum(profit) / any_value(days) AS m, sum(profit * profit) / any_value(days) AS q,
  any_value(days) AS days FROM p, span GROUP BY 1)),
 dev AS (SELECT col, r, m / sqrt((q - m * m) * days / (days - 1.0)) - own AS dev, own, days FROM boot JOIN own USING (col) WHERE q - m * m > 1e-12),
 z AS (SELECT col, any_value(own) / stddev_samp(dev) AS z, stddev_samp(dev) AS sd, any_value(days) AS days FROM dev GROUP BY 1),
 c AS MATERIALIZED (SELECT col, z, sd, days, row_number() OVER (ORDER BY z DESC, col) AS place FROM z),
 v AS MATERIALIZED (SELECT place, r, dev / sd + CASE WHEN c.z < -sqrt(2 * ln(ln(c.days))) THEN c.z ELSE 0 END AS d FROM dev JOIN c USING (col)), nc AS (SELECT count(*) AS n FROM c)"""
_SPARE = int(ALPHA * REPLICAS)


def _steps_sql(levels: str, stop: str = "false") -> str:
    """``st`` (k, began, done, over_): the steps of the procedure at each level of ``levels``, up to a ``stop``."""
    crit = f"""SELECT s.k, s.done, s.n, r, list_sort(list(d), 'DESC')[least(s.k, s.n - s.done + least(s.done, s.k - 1))] AS crit
   FROM (SELECT st.*, n FROM st, nc WHERE NOT over_ AND NOT ({stop})) s JOIN v ON v.place > s.done - least(s.done, s.k - 1) GROUP BY s.k, s.done, s.n, r"""
    cut = f"SELECT k, done, n, list_sort(list(crit))[{REPLICAS - _SPARE}] AS cut FROM ({crit}) GROUP BY k, done, n"
    found = f"SELECT x.k, x.done, x.n, count(*) FILTER (c.z > cut) AS rej FROM ({cut}) x, c GROUP BY x.k, x.done, x.n"
    return f"""st AS (SELECT k, CAST(0 AS BIGINT) AS began, CAST(0 AS BIGINT) AS done, CAST(0 AS BIGINT) AS rejected, false AS over_ FROM ({levels}) UNION ALL
  SELECT k, done, CASE WHEN rej > done THEN rej ELSE n END, greatest(rej, done), rej <= done OR rej >= n FROM ({found}))"""


#: Adjusted p of the columns by the steps ``st`` at the level in ``one`` (k).
_PVALUES_SQL = """crits AS (SELECT s.began, s.done, r, list_sort(list(d), 'DESC')[least(s.k, n - s.began + least(s.began, s.k - 1))] AS crit
  FROM (SELECT st.*, n FROM st JOIN one USING (k), nc WHERE done > began) s JOIN v ON v.place > s.began - least(s.began, s.k - 1) GROUP BY s.k, s.began, s.done, n, r),
 raw AS (SELECT c.col, c.z, c.place, avg(CASE WHEN crit >= c.z THEN 1.0 ELSE 0.0 END) AS p FROM c JOIN crits ON c.place > began AND c.place <= done GROUP BY 1, 2, 3)"""


@query(f"""WITH RECURSIVE {DEVIATIONS_SQL}, one AS (SELECT 3 AS k), {_steps_sql("SELECT 3 AS k")}, {_PVALUES_SQL}
 SELECT col, round(z, 6) AS z, place, round(max(p) OVER (ORDER BY place), 6) AS p FROM raw""")
def stepm_k_pvalues(spark, sf_dir):
    return multiple_testing.step_down_pvalues(supplier_columns(spark, sf_dir), "col", 3).select("col", r("z"), "place", r("p"))


#: The least level that ends with fewer rejections than the share allows; the procedures stop where they are sure to fail.
_FDP_SQL = f"""WITH RECURSIVE {DEVIATIONS_SQL}, {_steps_sql("SELECT unnest(range(1, n + 1)) AS k FROM nc", f"done >= ceil(st.k / {GAMMA} - 1) + 1")},
 one AS (SELECT min(k) AS k FROM (SELECT k, max(rejected) AS rejected FROM st GROUP BY 1) WHERE rejected < k / {GAMMA} - 1), {_PVALUES_SQL}"""


@query(f"{_FDP_SQL} SELECT col, round(z, 6) AS z, place, round(max(p) OVER (ORDER BY place), 6) AS p, CAST(k AS INT) AS k FROM raw, one")
def stepm_false_discoveries(spark, sf_dir):
    return multiple_testing.false_discovery_pvalues(supplier_columns(spark, sf_dir), "col").select("col", r("z"), "place", r("p"), "k")


@query(f"""{_FDP_SQL}, adj AS (SELECT col, z, place, max(p) OVER (ORDER BY place) AS p FROM raw)
 SELECT rule, x.col AS combo, round(x.z, 6) AS z, round(x.p, 6) AS p, x.p <= {ALPHA} AS passed
 FROM (SELECT s_nationkey AS rule, arg_min(struct_pack(col := col, z := z, p := p), place) AS x FROM adj JOIN supplier ON s_suppkey = col GROUP BY 1)""")
def stepm_best_columns(spark, sf_dir):
    """A rule is a nation, its columns are its suppliers."""
    found = multiple_testing.false_discovery_pvalues(supplier_columns(spark, sf_dir), "col")
    rows = found.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("col"), F.col("s_nationkey").alias("rule")), "col")
    return multiple_testing.best_of_each(rows.withColumnRenamed("col", "combo"), "rule", "combo").select("rule", "combo", r("z"), r("p"), "passed")


@query(f"""WITH {DEVIATIONS_SQL} SELECT CAST(count(*) AS BIGINT) AS replicas, round(avg(CASE WHEN top >= (SELECT max(z) FROM c) THEN 1.0 ELSE 0.0 END), 6) AS p
 FROM (SELECT r, max(d) AS top FROM v GROUP BY 1)""")
def reality_check_suppliers(spark, sf_dir):
    return stats.reality_check(supplier_columns(spark, sf_dir)).select("replicas", r("p"))


_PERCENTILES = f"unnest({[float(p) for p in multiple_testing.PERCENTILES]}) AS percentile"
_AT = [p / 100.0 for p in multiple_testing.PERCENTILES]


@query(f"""WITH {DEVIATIONS_SQL}, q AS (SELECT {_PERCENTILES}, unnest(quantile_cont(z, {_AT})) AS real FROM c), nq AS (SELECT r, {_PERCENTILES}, unnest(quantile_cont(d, {_AT})) AS x FROM v GROUP BY r)
 SELECT percentile, round(any_value(real), 6) AS real, round(avg(x), 6) AS simulated, round(100.0 * avg(CASE WHEN x < real THEN 1.0 ELSE 0.0 END), 6) AS below FROM nq JOIN q USING (percentile) GROUP BY 1""")
def percentile_bootstrap(spark, sf_dir):
    return multiple_testing.percentile_bootstrap(supplier_columns(spark, sf_dir), "col").select("percentile", r("real"), r("simulated"), r("below"))


# Greedy selections. ``near_sql`` has pairs (a, b), ``order_sql`` id and place.
def _greedy_sql(order_sql: str, near_sql: str) -> str:
    """The sequential pass: items with their place, and whether none of their better neighbours was kept."""
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT id, place FROM ({order_sql})), e AS MATERIALIZED (SELECT a, b FROM ({near_sql}) UNION SELECT b, a FROM ({near_sql})),
 nb AS MATERIALIZED (SELECT o.id, o.place, coalesce(list(x.id) FILTER (x.place < o.place), []) AS better FROM o LEFT JOIN e ON e.a = o.id LEFT JOIN o x ON x.id = e.b GROUP BY 1, 2),
 g AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT step + 1, CASE WHEN list_has_any(kept, better) THEN kept ELSE list_append(kept, id) END FROM g JOIN nb ON nb.place = step + 1)
 SELECT o.id, o.place, list_contains((SELECT arg_max(kept, step) FROM g), o.id) AS kept FROM o"""


ABOVE = 0.06
_CORR_SQL = f"""SELECT a.col AS a, b.col AS b FROM full_ a JOIN full_ b ON a.idx = b.idx AND a.col < b.col GROUP BY 1, 2 HAVING round(corr(a.profit, b.profit), 2) > {ABOVE}"""
_FULL_SQL = f"""(SELECT k.col, g.idx, coalesce(p.profit, 0.0) AS profit FROM (SELECT DISTINCT l_suppkey AS col FROM lineitem) k
 CROSS JOIN (SELECT unnest(range(min(idx), max(idx) + 1)) AS idx FROM {SUPPLIER_DAILY_SQL}) g LEFT JOIN {SUPPLIER_DAILY_SQL} p ON p.col = k.col AND p.idx = g.idx)"""


@query(_greedy_sql(f"SELECT col AS id, row_number() OVER (ORDER BY sum(profit) DESC, col) AS place FROM {SUPPLIER_DAILY_SQL} GROUP BY col", f"WITH full_ AS MATERIALIZED (SELECT * FROM {_FULL_SQL}) {_CORR_SQL}"))
def greedy_decorrelation(spark, sf_dir):
    daily = supplier_daily(spark, sf_dir)
    return selection.decorrelated(daily, daily.groupBy("col").agg(F.sum("profit").alias("gain")), "col", "gain", ABOVE).select("id", "place", "kept")


_RULE_SETS = rules.spec_sets()
_EVENTS_SQL = f"""SELECT n.rule_id AS id, h.symbol, h.t FROM {HITS_SQL} h JOIN (VALUES {", ".join(f"({2 * k + s}, {i}, {len(ids)})" for k, ids in enumerate(_RULE_SETS) for i in ids for s in (0, 1))}) n(rule_id, spec_id, need)
 ON n.spec_id = h.spec_id GROUP BY n.rule_id, h.symbol, h.t HAVING count(*) = any_value(n.need)"""
_ALIKE_SQL = """SELECT x.id AS a, y.id AS b FROM ev x JOIN ev y ON x.symbol = y.symbol AND x.t = y.t AND x.id < y.id AND (x.id - y.id) % 2 = 0 JOIN sz p ON p.id = x.id JOIN sz q ON q.id = y.id
 GROUP BY x.id, y.id, p.n, q.n HAVING count(*) / (p.n + q.n - count(*)) > 0.6"""
_SILENT_SQL = f"SELECT range AS id FROM range({2 * len(_RULE_SETS)}) ANTI JOIN ev ON ev.id = range"
_SIGNALS_SQL = f"""WITH ev AS MATERIALIZED ({_EVENTS_SQL}), sz AS (SELECT id, count(*) AS n FROM ev GROUP BY 1), silent AS ({_SILENT_SQL})
 {_ALIKE_SQL} UNION ALL SELECT x.id, y.id FROM silent x JOIN silent y ON x.id < y.id AND (x.id - y.id) % 2 = 0"""


@query(_greedy_sql(f"SELECT CAST(range AS BIGINT) AS id, range + 1 AS place FROM range({2 * len(_RULE_SETS)})", _SIGNALS_SQL))
def distinct_rule_signals(spark, sf_dir):
    """Rules in their order; one whose signals are those of a kept rule of its side to over 0.6 goes."""
    events = rules.events(rules.rules(spark), rules.hits(bars(spark, sf_dir))).select(F.col("rule_id").alias("id"), F.concat_ws("|", "symbol", "t").alias("element"))
    order = rules.rules(spark).select(F.col("rule_id").alias("id"), (F.col("rule_id") + 1).alias("place"), "side")
    return selection.distinct_signals(events, order, 0.6).select("id", "place", "kept")


# Walks and recursions.
def hourly_extremes(spark, sf_dir) -> DataFrame:
    """Hourly bars with the times of their extremes on quarter hours, raised so that returns are those of a market."""
    rows = etl.intrabar_extremes(bars(spark, sf_dir), bars(spark, sf_dir, "15m"), 3600)
    return rows.withColumns({c: F.col(c) + 1000.0 for c in ("open", "high", "low", "close")})


_WALK_SQL = f"""WITH RECURSIVE res AS MATERIALIZED ({ORACLES["first_touch_targets"].replace("round(g - 0.005 * (2 + g / 100.0), 6) + 0.0 AS y", "g - 0.005 * (2 + g / 100.0) AS y")}),
 nx AS MATERIALIZED (SELECT a.symbol, a.bar, a.y, min(b.bar) AS then_ FROM res a LEFT JOIN res b ON a.symbol = b.symbol AND b.bar > a.exit_bar GROUP BY 1, 2, 3),
 w AS (SELECT symbol, min(bar) AS pos, CAST(0.0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS n FROM res GROUP BY 1 UNION ALL SELECT w.symbol, then_, total + y, n + 1 FROM w JOIN nx ON nx.symbol = w.symbol AND nx.bar = w.pos)
 SELECT symbol, round(total, 6) AS total, n FROM w WHERE pos IS NULL"""


@query(_WALK_SQL)
def npy_walk(spark, sf_dir):
    found = exits.targets(extremes(spark, sf_dir), 10, 30.0, 30.0)
    return recurrence.walk_totals(found).select("symbol", r("total"), "n")


def _wilder_sql(x: str, n: int, name: str) -> str:
    """Wilder's mean of ``x`` over hourly bars by a recursion, from the mean of the first n values."""
    return f"""{name}_x AS MATERIALIZED (SELECT symbol, t, x, row_number() OVER (PARTITION BY symbol ORDER BY t) AS k FROM (SELECT symbol, t, {x} AS x FROM b) WHERE x IS NOT NULL),
 {name} AS (SELECT symbol, CAST({n} AS BIGINT) AS k, max(t) AS t, avg(x) AS y FROM {name}_x WHERE k <= {n} GROUP BY 1 HAVING count(*) = {n} UNION ALL
  SELECT v.symbol, v.k, v.t, ({name}.y * {n - 1} + v.x) / {n} FROM {name} JOIN {name}_x v ON v.symbol = {name}.symbol AND v.k = {name}.k + 1)"""


_CHANGES_SQL = f"b AS MATERIALIZED (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY t) AS d, lag(close) OVER (PARTITION BY symbol ORDER BY t) AS pc FROM {H1})"
RSI_N, ATR_N = 14, 14


def with_changes(rows: DataFrame) -> DataFrame:
    """``rows`` with d, the change of the close, and pc, the close before."""
    before = F.lag("close").over(in_order())
    return stretched(rows, back=1).withColumns({"pc": before, "d": F.col("close") - before}).filter("_own").select(*rows.columns, "d", "pc")


@query(f"""WITH RECURSIVE {_CHANGES_SQL}, {_wilder_sql("CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", RSI_N, "up")}, {_wilder_sql("CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END", RSI_N, "down")}
 SELECT symbol, t, round(100 * up.y / (up.y + down.y), 4) AS rsi FROM up JOIN down USING (symbol, t) WHERE up.y + down.y > 0""")
def wilder_rsi(spark, sf_dir):
    rows = with_changes(bars(spark, sf_dir)).select("symbol", "t", "d")
    # greatest passes over nulls.
    part = lambda d: F.when(F.col("d").isNotNull(), F.greatest(d, F.lit(0.0)))
    rows = recurrence.wilder(recurrence.wilder(rows, part(F.col("d")), RSI_N, "up"), part(-F.col("d")), RSI_N, "down")
    return rows.filter("up + down > 0").select("symbol", "t", F.round(100 * F.col("up") / (F.col("up") + F.col("down")), 4).alias("rsi"))


@query(f"""WITH RECURSIVE {_CHANGES_SQL}, {_wilder_sql("CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END", ATR_N, "tr")} SELECT symbol, t, round(y, 4) AS atr FROM tr""")
def wilder_atr(spark, sf_dir):
    rows = with_changes(bars(spark, sf_dir))
    width = F.when(F.col("pc").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc"))))
    return recurrence.wilder(rows, width, ATR_N, "atr").filter("atr IS NOT NULL").select("symbol", "t", r("atr", 4))


# Screening over hourly bars with the times of their extremes on quarter hours.
#: Thresholds that no ratio of small numbers meets exactly.
CUTS = {"rsi": [44.73, 55.31], "bb_pctb": [0.2317, 0.7733]}
CONFIGS, COMMISSION, PILOTS, PATHS, PERCENTILE = [(15.0, 15.0, 10)], exits.COMMISSION, 40, 60, 95.0
M15 = bars_sql("15m")
HOURLY_SQL = f"""(SELECT b.* REPLACE (open + 1000.0 AS open, high + 1000.0 AS high, low + 1000.0 AS low, close + 1000.0 AS close), x.high_time, x.low_time FROM {H1} b JOIN (SELECT symbol, min(t) AS first_t FROM {M15} GROUP BY 1) f ON b.symbol = f.symbol
 JOIN (SELECT symbol, max(t) AS last_t FROM {H1} GROUP BY 1) l ON b.symbol = l.symbol
 LEFT JOIN (SELECT symbol, t // 3600 * 3600 AS bar, arg_max(t, (high, -t)) AS high_time, arg_min(t, (low, t)) AS low_time FROM {M15} GROUP BY 1, 2) x ON b.symbol = x.symbol AND b.t = x.bar
 WHERE b.t < l.last_t AND b.t >= f.first_t)"""
_DECIMALS_SQL = ORACLES["price_decimals"].replace(H1, HOURLY_SQL)


def _paths_sql(first: int, n: int) -> str:
    """CTEs ``sb`` (the bars) and ``syn{first}``: paths of them, whose symbols carry their seed in front."""
    price = lambda log: f"round_even(base * exp({log}) * pow(10.0, decimals), 0) / pow(10.0, decimals)"
    return f"""logs{first} AS MATERIALIZED (SELECT b.*, seed, decimals, CASE WHEN substr(md5(seed || ':' || t), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS s FROM sb b JOIN dec USING (symbol), range({first}, {first + n}) p(seed)),
 base{first} AS (SELECT *, exp(lo + sum(s * rc) OVER (PARTITION BY seed, symbol ORDER BY t) - s * rc) AS base FROM logs{first}),
 raw{first} AS (SELECT seed, symbol, t, volume, {price("s * ro")} AS open, {price("s * rc")} AS close, {price("CASE WHEN s < 0 THEN -rl ELSE rh END")} AS h, {price("CASE WHEN s < 0 THEN -rh ELSE rl END")} AS l,
  CASE WHEN s < 0 THEN low_time ELSE high_time END AS high_time, CASE WHEN s < 0 THEN high_time ELSE low_time END AS low_time FROM base{first}),
 syn{first} AS MATERIALIZED (SELECT seed || '|' || symbol AS symbol, t, open, greatest(h, open, close) AS high, least(l, open, close) AS low, close, volume, high_time, low_time FROM raw{first})"""


_BARS_CTE = f"""src AS MATERIALIZED (SELECT * FROM {HOURLY_SQL}), dec AS MATERIALIZED ({_DECIMALS_SQL.replace(HOURLY_SQL, "src")}),
 pcs AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY t), open) AS pc, ln(first_value(open) OVER (PARTITION BY symbol ORDER BY t)) AS lo FROM src),
 sb AS MATERIALIZED (SELECT *, ln(open / pc) AS ro, ln(high / pc) AS rh, ln(low / pc) AS rl, ln(close / pc) AS rc FROM pcs)"""


@query(f"WITH {_BARS_CTE}, {_paths_sql(1, 8)} SELECT symbol, t, round(ln(open), 6) AS open, round(ln(high), 6) AS high, round(ln(low), 6) AS low, round(ln(close), 6) AS close, volume, high_time, low_time FROM syn1")
def synthetic_paths(spark, sf_dir):
    rows = hourly_extremes(spark, sf_dir)
    paths = null_screen.synthetic(rows, spark.range(1, 9).withColumnRenamed("id", "seed"), etl.price_decimals(rows))
    return paths.select(F.concat_ws("|", "seed", "symbol").alias("symbol"), "t", *[F.round(F.ln(c), 6).alias(c) for c in ("open", "high", "low", "close")], "volume", "high_time", "low_time")


def _codes_sql(source: str) -> str:
    """(symbol, t, indicator, instance, bin) of every grid point."""
    parts = []
    for name, ths in CUTS.items():
        bin_ = " + ".join(f"CASE WHEN value > {c} THEN 2 WHEN value = {c} THEN 1 ELSE 0 END" for c in ths)
        parts += [f"SELECT symbol, t, '{name}' AS indicator, '{key}' AS instance, {bin_} AS bin FROM {indicator_sql(source, name, params)} WHERE value IS NOT NULL" for key, params in REGISTRY[name].instances()]
    return " UNION ALL ".join(parts)


def _targets_sql(source: str) -> str:
    """(symbol, t, target, y) of the long and the short result of the one configuration."""
    (tp, sl, horizon), parts = CONFIGS[0], []
    for target, sign in ((0, 1), (1, -1)):
        good, bad = f"e.close * {1 + sign * tp / 100.0}", f"e.close * {1 - sign * sl / 100.0}"
        win, lose = (f"f.high >= {good}", f"f.low <= {bad}") if sign > 0 else (f"f.low <= {good}", f"f.high >= {bad}")
        earlier = "f.high_time < f.low_time" if sign > 0 else "f.low_time < f.high_time"
        parts.append(f"""SELECT symbol, t, {target} AS target, g - {COMMISSION} * (2 + {sign} * g / 100.0) AS y FROM (SELECT e.symbol, e.t,
   coalesce(arg_min(CASE WHEN ({win}) AND (NOT ({lose}) OR coalesce({earlier}, false)) THEN {tp} ELSE -{sl} END, f.bar) FILTER (({win}) OR ({lose})), {sign} * (max(f.close) FILTER (f.bar = e.bar + {horizon}) / any_value(e.close) - 1) * 100.0) AS g
   FROM nb e JOIN nb f ON e.symbol = f.symbol AND f.bar > e.bar AND f.bar <= e.bar + {horizon} WHERE e.bar + {horizon} < e.n GROUP BY e.symbol, e.t)""")
    return f"WITH nb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar, count(*) OVER (PARTITION BY symbol) AS n FROM {source}) " + " UNION ALL ".join(parts)


def _edge_sql(n: str, s: str, q: str) -> str:
    """Edge of a segment against all (an, as_, aq), null where it doesn't count."""
    sd = lambda q, s, n: f"sqrt(greatest({q} / {n} - ({s} / {n}) * ({s} / {n}), 0.0))"
    least = null_screen.LEAST
    return f"CASE WHEN {n} >= {least} AND an - {n} >= {least} AND {sd('aq', 'as_', 'an')} > 0 THEN ({s} / {n} - as_ / an) / (greatest({sd(q, s, n)}, {sd('aq', 'as_', 'an')}) / sqrt({n})) END"


def _edges_sql(source: str, name: str) -> str:
    """CTEs that end in ``name`` (symbol, indicator, instance, target, cut, side, edge, excess)."""
    cuts = ", ".join(f"('{k}', {c}, '{side}')" for k, ths in CUTS.items() for c in range(len(ths)) for side in "<>")
    inside = "CASE side WHEN '<' THEN bin < 2 * cut + 1 ELSE bin > 2 * cut + 1 END"
    return f"""{name}b AS MATERIALIZED (SELECT symbol, indicator, instance, target, bin, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM ({_codes_sql(source)}) JOIN ({_targets_sql(source)}) USING (symbol, t) GROUP BY ALL),
 {name}s AS (SELECT symbol, indicator, instance, target, cut, side, coalesce(sum(n) FILTER ({inside}), 0) AS n, coalesce(sum(s) FILTER ({inside}), 0) AS s, coalesce(sum(q) FILTER ({inside}), 0) AS q,
  sum(n) AS an, sum(s) AS as_, sum(q) AS aq FROM {name}b JOIN (VALUES {cuts}) c(indicator, cut, side) USING (indicator) GROUP BY ALL),
 {name} AS MATERIALIZED (SELECT * FROM (SELECT symbol, indicator, instance, target, cut, side, {_edge_sql("n", "s", "q")} AS edge, s - n * as_ / an AS excess FROM {name}s) WHERE edge IS NOT NULL)"""


@query(f"WITH {_BARS_CTE}, {_edges_sql('src', 'e')} SELECT symbol, indicator, instance, target, cut, side, round(edge, 6) AS edge, round(excess, 4) AS excess FROM e")
def segment_edges_by_symbol(spark, sf_dir):
    rows = hourly_extremes(spark, sf_dir)
    return null_screen.edges(rows, CUTS, CONFIGS, COMMISSION).select("symbol", "indicator", "instance", "target", "cut", "side", r("edge"), r("excess", 4))


_COMBO = "instance, target, cut, side"
_SPLIT = "CAST(split_part(x.symbol, '|', 1) AS BIGINT) AS seed, split_part(x.symbol, '|', 2) AS symbol"
_PILOT, _NULL = null_screen.SEED_PILOT, null_screen.SEED_NULL


@query(f"""WITH {_BARS_CTE}, {_paths_sql(_PILOT, PILOTS)}, {_edges_sql(f"syn{_PILOT}", "pe")}, {_paths_sql(_NULL, PATHS)}, {_edges_sql(f"syn{_NULL}", "ne")}, {_edges_sql("src", "e")},
 known AS MATERIALIZED (SELECT symbol, indicator, {_COMBO}, avg(edge) AS mu, stddev_samp(edge) AS sd FROM (SELECT x.* EXCLUDE (symbol), {_SPLIT} FROM pe x) GROUP BY ALL HAVING count(*) >= {null_screen.LEAST_PILOTS} AND stddev_samp(edge) > 1e-12),
 tops AS (SELECT seed, symbol, indicator, max((edge - mu) / sd) AS top FROM (SELECT x.* EXCLUDE (symbol), {_SPLIT} FROM ne x WHERE excess > 0) JOIN known USING (symbol, indicator, {_COMBO}) GROUP BY 1, 2, 3),
 every AS (SELECT symbol, indicator, coalesce(top, -1e9) AS top FROM (SELECT DISTINCT symbol, indicator, seed FROM known, range({_NULL}, {_NULL + PATHS}) p(seed)) LEFT JOIN tops USING (seed, symbol, indicator)),
 fl AS (SELECT symbol, indicator, quantile_cont(top, {PERCENTILE / 100}) AS floor, quantile_cont(top, 0.5) AS med, quantile_cont(top, 0.84) AS p84 FROM every GROUP BY 1, 2),
 z AS (SELECT e.*, (edge - mu) / sd AS z FROM e JOIN known USING (symbol, indicator, {_COMBO}) WHERE excess > 0),
 t AS (SELECT symbol, indicator, max(z) AS T, any_value(floor) AS floor, any_value(med) AS med, any_value(p84) AS p84,
  arg_min(struct_pack(instance := instance, target := target, cut := cut, side := side, z := z, excess := excess), (-excess, {_COMBO})) FILTER (z > floor) AS x FROM z JOIN fl USING (symbol, indicator) GROUP BY 1, 2)
 SELECT symbol, indicator, round(T, 4) AS T, round(floor, 4) AS floor, round((T - med) / (p84 - med), 4) AS score, T > floor AS passed, x.instance AS instance, x.target AS target, x.cut AS cut, x.side AS side,
 round(x.z, 4) AS z, round(x.excess, 4) AS excess FROM t""")
def screen_alone(spark, sf_dir):
    rows = hourly_extremes(spark, sf_dir)
    found = null_screen.screen(rows, CUTS, CONFIGS, PERCENTILE, COMMISSION, PILOTS, PATHS, etl.price_decimals(rows))
    return found.select("symbol", "indicator", r("T", 4), r("floor", 4), r("score", 4), "passed", "instance", "target", "cut", "side", r("z", 4), r("excess", 4))


# Pairs of indicators under shifts around the circle of a symbol's bars.
PAIR_CUTS = {"rsi": [44.73, 55.31], "bb_pctb": [0.2317, 0.7733], "close_pos_in_bar": [0.6131]}
LEAST_SHIFT, SOME_PILOTS, SOME_PATHS = 110, 4, 8
_PAIR_INSTANCES = null_screen.instances(PAIR_CUTS)


def _hash_sql(seed: int, x: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {x}), 1, 8) AS BIGINT)"


def _shifts_sql(pilots: int, paths: int) -> str:
    """CTE ``sh`` (symbol, n, kind, draw, shift) by the sizes in ``nbar``."""
    return f"""sizes AS (SELECT symbol, count(*) AS n FROM nbar GROUP BY 1 HAVING count(*) > {2 * LEAST_SHIFT}),
 nulls AS (SELECT symbol, n, 'null' AS kind, draw, {LEAST_SHIFT} + {_hash_sql(_NULL, "draw")} % (n - {2 * LEAST_SHIFT} + 1) AS shift FROM sizes, range({paths}) d(draw)),
 free AS (SELECT symbol, n, 'pilot' AS kind, row_number() OVER (PARTITION BY symbol ORDER BY {_hash_sql(_PILOT, "shift")}, shift) - 1 AS draw, shift
  FROM (SELECT symbol, n, unnest(range({LEAST_SHIFT}, n - {LEAST_SHIFT} + 1)) AS shift FROM sizes) ANTI JOIN nulls USING (symbol, shift)),
 sh AS MATERIALIZED (SELECT * FROM nulls UNION ALL SELECT * FROM free WHERE draw < {pilots} UNION ALL SELECT symbol, n, 'real', 0, 0 FROM sizes)"""


def _pair_edges_sql(cuts: dict[str, list[float]], pilots: int, paths: int) -> str:
    """CTEs that end in ``pe``: edges of all rectangles of two segments, of each draw and either moved indicator."""
    order = null_screen.instances(cuts)
    codes = " UNION ALL ".join(
        f"SELECT symbol, t, {k} AS k, {' + '.join(f'CASE WHEN value > {c} THEN 2 WHEN value = {c} THEN 1 ELSE 0 END' for c in cuts[name])} AS bin FROM {indicator_sql('src', name, dict(REGISTRY[name].instances())[key])} WHERE value IS NOT NULL"
        for k, (name, key) in enumerate(order)
    )
    segments = ", ".join(f"({k}, {c}, '{side}')" for k, (name, _) in enumerate(order) for c in range(len(cuts[name])) for side in "<>")
    pairs = ", ".join(f"({x}, {z})" for x, z in null_screen.instance_pairs(order))
    inside = lambda x, i: f"CASE {x}.side WHEN '<' THEN {i} < 2 * {x}.cut + 1 ELSE {i} > 2 * {x}.cut + 1 END"
    keys, in_a, in_b, least = "symbol, kind, draw, a, b, moved, target", inside("x", "i"), inside("z", "j"), null_screen.LEAST
    both = f"({in_a}) AND ({in_b})"
    return f"""nbar AS MATERIALIZED (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar FROM src),
 {_shifts_sql(pilots, paths)}, code AS MATERIALIZED (SELECT symbol, bar, k, bin FROM ({codes}) JOIN nbar USING (symbol, t)),
 ys AS MATERIALIZED (SELECT symbol, bar, target, y FROM ({_targets_sql("src")}) JOIN nbar USING (symbol, t)),
 of_(a, b) AS (VALUES {pairs}),
 far AS MATERIALIZED (SELECT symbol, kind, draw, (bar - shift + n) % n AS bar, k, bin FROM sh JOIN code USING (symbol)),
 met AS (SELECT symbol, kind, draw, a, b, 'b' AS moved, bar, f.bin AS i, g.bin AS j FROM code f JOIN of_ ON f.k = a JOIN far g USING (symbol, bar) WHERE g.k = b
  UNION ALL SELECT symbol, kind, draw, a, b, 'a', bar, f.bin, g.bin FROM code g JOIN of_ ON g.k = b JOIN far f USING (symbol, bar) WHERE f.k = a),
 h AS MATERIALIZED (SELECT {keys}, i, j, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM met JOIN ys USING (symbol, bar) GROUP BY ALL), seg(k, cut, side) AS (VALUES {segments}),
 rect AS (SELECT {keys}, x.cut AS cut_a, x.side AS side_a, z.cut AS cut_b, z.side AS side_b, sum(n) FILTER ({both}) AS n, sum(s) FILTER ({both}) AS s, sum(q) FILTER ({both}) AS q,
  sum(n) AS an, sum(s) AS as_, sum(q) AS aq, sum(n) FILTER ({in_a}) AS na, sum(n) FILTER ({in_b}) AS nb FROM h JOIN seg x ON x.k = a JOIN seg z ON z.k = b GROUP BY ALL),
 pe AS MATERIALIZED (SELECT * FROM (SELECT {keys}, cut_a, side_a, cut_b, side_b, n, {_edge_sql("n", "s", "q")} AS edge, s - n * as_ / an AS excess, na - n >= {least} AND nb - n >= {least} AS valid FROM rect) WHERE edge IS NOT NULL)"""


@query(f"""WITH src AS MATERIALIZED (SELECT * FROM {HOURLY_SQL}), {_pair_edges_sql(PAIR_CUTS, SOME_PILOTS, SOME_PATHS)}
 SELECT symbol, kind, draw, a, b, moved, target, cut_a, side_a, cut_b, side_b, CAST(n AS BIGINT) AS n, round(edge, 5) AS edge, round(excess, 3) AS excess, valid FROM pe""")
def shifted_pair_edges(spark, sf_dir):
    rows = null_screen.coded_bars(hourly_extremes(spark, sf_dir), PAIR_CUTS, CONFIGS, COMMISSION)
    shifts = null_screen.drawn_shifts(rows.groupBy("symbol").agg(F.count("*").alias("n")), LEAST_SHIFT, SOME_PILOTS, SOME_PATHS)
    found = null_screen.rectangle_edges(null_screen.shifted_histograms(rows, shifts, null_screen.instance_pairs(_PAIR_INSTANCES)), [len(PAIR_CUTS[name]) for name, _ in _PAIR_INSTANCES])
    return found.withColumns({"edge": F.round("edge", 5), "excess": F.round("excess", 3)})


_PAIR_KEYS = "symbol, a, b, target, cut_a, side_a, cut_b, side_b"
_LIMITS = ", ".join(f"max({c}) FILTER (moved = '{m}') AS {c}_{m}" for c in ("floor", "med", "p84") for m in "ab")


@query(f"""WITH src AS MATERIALIZED (SELECT * FROM {HOURLY_SQL}), {_pair_edges_sql(CUTS, PILOTS, PATHS)},
 names(k, name) AS (VALUES {", ".join(f"({k}, '{name}')" for k, (name, _) in enumerate(null_screen.instances(CUTS)))}),
 known AS (SELECT {_PAIR_KEYS}, moved, avg(edge) AS mu, stddev_samp(edge) AS sd FROM pe WHERE kind = 'pilot' GROUP BY ALL HAVING count(*) >= {null_screen.LEAST_PILOTS} AND stddev_samp(edge) > 1e-12),
 sc AS MATERIALIZED (SELECT pe.*, u.name AS name_a, w.name AS name_b, least((edge - ka.mu) / ka.sd, (edge - kb.mu) / kb.sd) AS z FROM pe JOIN (SELECT * FROM known WHERE moved = 'a') ka USING ({_PAIR_KEYS})
  JOIN (SELECT * FROM known WHERE moved = 'b') kb USING ({_PAIR_KEYS}) JOIN names u ON u.k = pe.a JOIN names w ON w.k = pe.b WHERE excess > 0),
 tops AS (SELECT symbol, name_a, name_b, moved, draw, max(z) AS top FROM sc WHERE kind = 'null' GROUP BY ALL),
 every AS (SELECT * REPLACE (coalesce(top, -1e9) AS top) FROM (SELECT DISTINCT symbol, name_a, name_b, m AS moved, d.draw FROM sc, (VALUES ('a'), ('b')) v(m), range({PATHS}) d(draw)) LEFT JOIN tops USING (symbol, name_a, name_b, moved, draw)),
 fl AS (SELECT symbol, name_a, name_b, {_LIMITS} FROM (SELECT symbol, name_a, name_b, moved, quantile_cont(top, {PERCENTILE / 100}) AS floor, quantile_cont(top, 0.5) AS med, quantile_cont(top, 0.84) AS p84 FROM every GROUP BY ALL) GROUP BY ALL),
 t AS (SELECT symbol, name_a, name_b, max(z) AS T, any_value(COLUMNS('^(floor|med|p84)_[ab]$')), arg_min(struct_pack(a := a, b := b, target := target, z := z, excess := excess), (-excess, a, b, target, cut_a, side_a, cut_b, side_b)) FILTER (z > floor_a AND z > floor_b) AS x
  FROM sc JOIN fl USING (symbol, name_a, name_b) WHERE kind = 'real' AND moved = 'b' AND valid GROUP BY ALL)
 SELECT symbol, name_a, name_b, round(T, 4) AS T, round(greatest(floor_a, floor_b), 4) AS floor, T > floor_a AND T > floor_b AS passed, x.a AS a, x.b AS b, x.target AS target, round(x.z, 4) AS z, round(x.excess, 3) AS excess FROM t""")
def screen_pairs(spark, sf_dir):
    found = null_screen.screen_pairs(hourly_extremes(spark, sf_dir), CUTS, CONFIGS, PERCENTILE, COMMISSION, PILOTS, PATHS, LEAST_SHIFT)
    return found.select("symbol", "name_a", "name_b", r("T", 4), r("floor", 4), "passed", "a", "b", "target", r("z", 4), r("excess", 3))


# Paths of permuted blocks.
#: Paths that are given bar by bar.
SHOWN = 200


def four_hour_market(spark, sf_dir) -> DataFrame:
    """Four-hour bars with the times of their extremes, raised so that returns are those of a market."""
    return extremes(spark, sf_dir).withColumns({c: F.col(c) + 1000.0 for c in ("open", "high", "low", "close")})


MARKET_SQL = f"(SELECT * REPLACE (open + 1000.0 AS open, high + 1000.0 AS high, low + 1000.0 AS low, close + 1000.0 AS close) FROM {EXTREMES_SQL})"


def _joint_sql(paths: int, block: int) -> str:
    """CTEs that end in ``jp``: bars of the paths."""
    h = lambda x: f"CAST('0x' || substr(md5('{multiverse.SEED}:' || path || ':' || {x}), 1, 8) AS BIGINT)"
    return f"""src AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS k, coalesce(lag(close) OVER w, open) AS pc, first_value(open) OVER w AS o0 FROM {MARKET_SQL} WINDOW w AS (PARTITION BY symbol ORDER BY t)),
 tl AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM src)),
 ph AS (SELECT path, {h("'phase'")} % {block} AS phase FROM range(1, {paths + 1}) p(path)),
 bl AS (SELECT path, phase, unnest(range(CAST((phase > 0)::INT + ceil(((SELECT max(n) FROM tl) - phase) / {block}.0) AS BIGINT))) AS blk FROM ph),
 pl AS MATERIALIZED (SELECT path, phase, blk, row_number() OVER (PARTITION BY path ORDER BY {h("blk")}, blk) AS place FROM bl),
 mv AS (SELECT path, symbol, s.*  EXCLUDE (symbol), row_number() OVER (PARTITION BY path, symbol ORDER BY place, pos) - 1 AS kk
  FROM src s JOIN tl USING (t) JOIN pl ON pl.blk = CASE WHEN pos < phase THEN 0 ELSE (phase > 0)::INT + (pos - phase) // {block} END),
 cs AS (SELECT *, o0 * exp(sum(ln(close / pc)) OVER (PARTITION BY path, symbol ORDER BY kk)) AS nc FROM mv),
 jp AS MATERIALIZED (SELECT cs.path, cs.symbol, o.t, nc * open_ / close_ AS open, nc * open_ / close_ * high_ / open_ AS high, nc * open_ / close_ * low_ / open_ AS low, nc AS close, volume, o.t + high_time - told AS high_time,
  o.t + low_time - told AS low_time FROM (SELECT path, symbol, kk, nc, open AS open_, high AS high_, low AS low_, close AS close_, volume, high_time, low_time, t AS told FROM cs) cs JOIN (SELECT symbol, k, t FROM src) o ON o.symbol = cs.symbol AND o.k = cs.kk)"""


@query(f"""WITH {_joint_sql(SHOWN, multiverse.BLOCK)} SELECT path, symbol, t, round(ln(open), 6) AS open, round(ln(high), 6) AS high, round(ln(low), 6) AS low, round(ln(close), 6) AS close, volume, high_time, low_time FROM jp""")
def multiverse_paths(spark, sf_dir):
    paths = multiverse.joint_paths(four_hour_market(spark, sf_dir), SHOWN)
    return paths.select("path", "symbol", "t", *[F.round(F.ln(c), 6).alias(c) for c in ("open", "high", "low", "close")], "volume", "high_time", "low_time")


@query(f"""WITH {_joint_sql(100, multiverse.BLOCK)}, pb AS MATERIALIZED (SELECT path || '|' || symbol AS symbol, t, open, high, low, close, volume, high_time, low_time FROM jp),
 rb AS MATERIALIZED (SELECT symbol, t, open, high, low, close, volume, high_time, low_time FROM src),
 nul AS (SELECT CAST(split_part(symbol, '|', 1) AS BIGINT) AS path, split_part(symbol, '|', 2) AS symbol, avg(y) AS value FROM {indicator_sql("pb", "donchian_pos", {"period": 7})} JOIN ({_targets_sql("pb")}) USING (symbol, t) WHERE target = 0 AND value < 0.3317 GROUP BY 1, 2),
 rea AS (SELECT symbol, avg(y) AS value FROM {indicator_sql("rb", "donchian_pos", {"period": 7})} JOIN ({_targets_sql("rb")}) USING (symbol, t) WHERE target = 0 AND value < 0.3317 GROUP BY 1)
 SELECT symbol, round(value, 6) AS value, round((1 + (SELECT count(*) FROM nul WHERE nul.symbol = rea.symbol AND nul.value >= rea.value)) / 101.0, 6) AS p FROM rea""")
def multiverse_pvalues(spark, sf_dir):
    """Mean result of long entries in the lowest third of a channel, against paths without order."""
    rows = four_hour_market(spark, sf_dir)

    def means(of: DataFrame) -> DataFrame:
        low = with_indicator(of, "donchian_pos", {"period": 7}).filter("value < 0.3317")
        return low.select("symbol", "t").join(exits.grid_targets(of, CONFIGS, COMMISSION).filter("target = 0"), ["symbol", "t"]).groupBy("symbol").agg(multiverse.exact_mean("y").alias("value"))

    paths = multiverse.joint_paths(rows, 100).withColumn("symbol", F.concat_ws("|", "path", "symbol")).drop("path")
    part = F.split("symbol", r"\|", 2)
    null = means(paths).select(F.get(part, 0).cast("long").alias("path"), F.get(part, 1).alias("symbol"), "value")
    return multiverse.permutation_pvalues(means(rows), null, ["symbol"], 100).select("symbol", r("value"), r("p"))


# Matches. Purchases take clicks of their user in the day before, each once.
DAY_US = 86_400_000_000


@query(f"""WITH RECURSIVE p AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase'),
 cand AS MATERIALIZED (SELECT p.user_id, p.event_id, p.k, coalesce(list(c.event_id ORDER BY c.ts, c.event_id) FILTER (c.event_id IS NOT NULL), []) AS free
  FROM p LEFT JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND epoch_us(c.ts) BETWEEN p.us - {DAY_US} AND p.us GROUP BY 1, 2, 3),
 g AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS later_id, CAST(NULL AS BIGINT) AS earlier_id FROM p WHERE k = 1 UNION ALL
  SELECT user_id, k, CASE WHEN x IS NULL THEN used ELSE list_append(used, x) END, event_id, x FROM (SELECT g.user_id, c.k, g.used, c.event_id, list_filter(c.free, lambda i: NOT list_contains(g.used, i))[1] AS x
   FROM g JOIN cand c ON c.user_id = g.user_id AND c.k = g.k + 1))
 SELECT later_id, earlier_id FROM g WHERE earlier_id IS NOT NULL""")
def one_to_one_match(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    return matching.one_to_one(events.filter("event_type = 'purchase'"), events.filter("event_type = 'click'"), DAY_US)
