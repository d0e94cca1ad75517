"""Registered query of portfolios under side and timeframe rules, with DuckDB text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candleforge.operators import portfolios, trades
from candleforge.plans.catalog import T, query, r
from candleforge.sources.shared import Tables

#: Strategies at most, sizes of sets, months of a subperiod. The return flag stands in for the timeframe, so there are six
#: groups of timeframe and side to cover.
CAP, LEAST, MOST, MONTHS = 25, 2, 6, 12

_STRATEGY_SQL = "strategy || '|' || substr(symbol, 1, 1) || '|' || side"
#: A subperiod's number by calendar steps back from the last day; each step starts from the one before.
_SQL = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT {_STRATEGY_SQL} AS id, substr(symbol, 1, 1) || side AS grp, sell_day AS day, sum(profit) AS profit FROM {T} GROUP BY 1, 2, 3),
 k AS (SELECT id, grp, row_number() OVER (ORDER BY sum(profit) DESC, id) AS rank FROM t GROUP BY 1, 2),
 capped AS (SELECT id, grp FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY grp) AS g FROM k) ORDER BY turn, g LIMIT {CAP}),
 ids AS MATERIALIZED (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS idx, CAST(1 << (dense_rank() OVER (ORDER BY grp) - 1) AS BIGINT) AS bit FROM capped),
 d AS MATERIALIZED (SELECT idx, day, profit FROM t JOIN ids USING (id)), ends AS (SELECT min(day) AS a, max(day) AS z FROM d),
 cuts AS (SELECT CAST(0 AS BIGINT) AS step, z AS day, a FROM ends UNION ALL
  SELECT step + 1, b, a FROM (SELECT step, a, epoch_us(DATE '1970-01-01' + CAST(day AS INT) - INTERVAL {MONTHS} MONTH) // 86400000000 AS b FROM cuts) WHERE b - a >= {MONTHS} * {portfolios.DAYS_A_MONTH}),
 spans AS (SELECT max(step) OVER () - step AS sub, coalesce(lead(day) OVER (ORDER BY step), a) AS lo, CASE WHEN step = 0 THEN day ELSE day - 1 END AS hi FROM cuts),
 grid AS (SELECT sub, unnest(range(lo, hi + 1)) AS day FROM (SELECT sub, min(day) AS lo, max(day) AS hi FROM d JOIN spans ON day BETWEEN lo AND hi GROUP BY 1)),
 c AS (SELECT CAST(0 AS BIGINT) AS combo, CAST(-1 AS BIGINT) AS last, CAST(0 AS BIGINT) AS bits, CAST(0 AS BIGINT) AS size UNION ALL
  SELECT combo + CAST(1 << idx AS BIGINT), idx, bits | bit, size + 1 FROM c JOIN ids ON idx > last WHERE size < {MOST}),
 s AS MATERIALIZED (SELECT combo, size FROM c WHERE size >= {LEAST} AND bits = (SELECT bit_or(bit) FROM ids)),
 m AS MATERIALIZED (SELECT combo, idx FROM s JOIN ids ON (combo >> idx) & 1 = 1),
 own AS (SELECT sub, idx, day, profit FROM d JOIN spans ON day BETWEEN lo AND hi),
 base AS MATERIALIZED (SELECT combo, sub, count(*) * {portfolios.CAPITAL} AS base FROM m JOIN (SELECT DISTINCT sub, idx FROM own) USING (idx) GROUP BY 1, 2),
 y AS (SELECT combo, sub, day, sum(profit) AS gain FROM m JOIN own USING (idx) GROUP BY 1, 2, 3),
 f AS (SELECT combo, sub, day, base, coalesce(gain, 0.0) AS gain FROM base JOIN grid USING (sub) LEFT JOIN y USING (combo, sub, day)),
 e AS (SELECT *, base + sum(gain) OVER w AS equity, min(CASE WHEN gain != 0 THEN day END) OVER (PARTITION BY combo, sub) AS a, max(CASE WHEN gain != 0 THEN day END) OVER (PARTITION BY combo, sub) AS z
  FROM f WINDOW w AS (PARTITION BY combo, sub ORDER BY day)),
 x AS (SELECT combo, sub, sum(gain) AS gain, regr_r2(equity, day) FILTER (day BETWEEN a AND z) AS r2 FROM e GROUP BY 1, 2),
 v AS (SELECT combo, size, n.sub, CASE WHEN gain > 0 AND NOT isnan(r2) THEN round(r2, 3) END AS score FROM s CROSS JOIN (SELECT DISTINCT sub FROM grid) n LEFT JOIN x USING (combo, sub)),
 p AS (SELECT *, CASE WHEN score IS NULL THEN count(*) OVER (PARTITION BY sub) ELSE row_number() OVER (PARTITION BY sub ORDER BY score DESC NULLS LAST, combo) END AS rank FROM v),
 w AS (SELECT sub, n, row_number() OVER (ORDER BY sub) = n AS is_last FROM (SELECT sub, count(*) OVER () AS n FROM (SELECT DISTINCT sub FROM grid)))
 SELECT combo, any_value(size) AS size, count(score) AS n_scored, round(sum(rank * CASE WHEN is_last THEN round(2 / n, 6) ELSE round((1 - 2 / n) / (n - 1), 6) END), 6) AS weighted_rank FROM p JOIN w USING (sub) GROUP BY combo"""


@query(_SQL)
def portfolio_subperiods(spark, sf_dir):
    """Every set of the capped strategies that has both sides of each timeframe, by its weighted rank over subperiods."""
    flag = F.substring("symbol", 1, 1)
    rows = trades.trades(spark, sf_dir).select(F.concat_ws("|", "strategy", flag, "side").alias("id"), F.concat(flag, "side").alias("grp"), F.col("sell_day").alias("day"), "profit")
    # At most a row for each strategy and day, stored so that lines and orders are joined once.
    daily = Tables(spark).kept(rows.groupBy("id", "grp", "day").agg(F.sum("profit").alias("profit")))
    gains = daily.groupBy("id", "grp").agg(F.sum("profit").alias("p"))
    order = gains.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("p"), "id")).cast("long"))
    ids = portfolios.numbered_ids(trades.round_robin(order.select("id", "grp", "rank"), CAP).select("id", "grp")).persist()
    own = daily.join(F.broadcast(ids.select("id", "idx")), "id").select("idx", "day", "profit")
    first, last = own.agg(F.min("day"), F.max("day")).first()
    spans = portfolios.subperiods(first, last, MONTHS)
    out = portfolios.ranked(portfolios.scored(portfolios.covering_sets(ids, LEAST, MOST), own, spans))
    names = [c for c in out.columns if c.startswith("s") and c[1:].isdigit()]
    n_scored = sum((F.col(c).isNotNull().cast("long") for c in names), F.lit(0).cast("long"))
    return out.select("combo", "size", n_scored.alias("n_scored"), r("weighted_rank"))
