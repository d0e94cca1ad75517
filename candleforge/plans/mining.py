"""Registered queries of rules from whole grids, with DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.operators import rule_grid
from candleforge.operators.indicators import REGISTRY, indicator_sql
from candleforge.plans.catalog import H4, query, r
from candleforge.sources.bars import bars

SPECS, LEAST = rule_grid.expansion(), 30


def _hits_sql() -> str:
    """CTEs ``s`` (spec_id, place, instance, op, cut) and ``h`` (spec_id, place, symbol, bar, y), all conditions' events."""
    specs = ", ".join(f"({s.spec_id}, {s.place}, '{s.instance}', '{s.op}', {s.threshold})" for s in SPECS)
    values = " UNION ALL ".join(
        f"SELECT '{key}' AS instance, symbol, t, value FROM {indicator_sql('hb', name, params)}" for name in REGISTRY for key, params in REGISTRY[name].instances()
    )
    return f"""hb AS MATERIALIZED (SELECT * FROM {H4}), s(spec_id, place, instance, op, cut) AS (VALUES {specs}),
 n AS (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar, CASE WHEN open > 0 THEN (close / open - 1) * 100.0 END AS y FROM hb),
 v AS MATERIALIZED (SELECT instance, symbol, t, lag(value) OVER (PARTITION BY instance, symbol ORDER BY t) AS value FROM ({values})),
 h AS MATERIALIZED (SELECT spec_id, place, symbol, bar, y FROM v JOIN s USING (instance) JOIN n USING (symbol, t)
  WHERE y IS NOT NULL AND CASE op WHEN '>' THEN value > cut ELSE value < cut END)"""


#: Rules ``q`` (rule_no, a, b, pa, pb, n, total, rules) to depth 2, numbered by their order; b is -1 for single conditions.
RULES_SQL = f"""{_hits_sql()}, e AS (SELECT x.spec_id AS a, z.spec_id AS b, count(*) AS n, sum(x.y) AS total
  FROM h x JOIN h z ON x.symbol = z.symbol AND x.bar = z.bar AND x.place < z.place GROUP BY 1, 2
  UNION ALL SELECT spec_id, -1, count(*), sum(y) FROM h GROUP BY 1),
 l AS (SELECT x.spec_id AS a, z.spec_id AS b, x.place AS pa, z.place AS pb FROM s x JOIN s z ON x.place < z.place UNION ALL SELECT spec_id, -1, place, -1 FROM s),
 q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY b >= 0, pa, pb, a, b) - 1 AS rule_no, a, b, pa, pb, coalesce(n, 0) AS n, total, count(*) OVER () AS rules
  FROM l LEFT JOIN e USING (a, b))"""
#: Both sides of them, and of each two indicators the best.
SIDES_SQL = """SELECT rule_no AS rule_id, 'LONG' AS side, a, b, pa, pb, n, total / n AS mean FROM q UNION ALL
 SELECT rule_no + rules, 'SHORT', a, b, pa, pb, n, -total / n FROM q"""
BEST_SQL = f"""best AS MATERIALIZED (SELECT unnest(arg_max(x, (round(x.mean, 9), -x.rule_id))) FROM (SELECT x FROM ({SIDES_SQL}) x WHERE b >= 0 AND n >= {LEAST}) GROUP BY x.pa, x.pb)"""


def _grown(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, conditions and all rules to depth 2 of the 4-hour bars."""
    words, specs = rule_grid.signal_words(bars(spark, sf_dir, "4H"), SPECS), rule_grid.spec_table(spark, SPECS)
    one = rule_grid.singles(words, specs)
    two = rule_grid.grown(words, specs, specs.select(F.array("spec_id").alias("spec_ids")))
    found = rule_grid.place_of_rule(SPECS, specs, one.unionByName(two))
    return words, specs, rule_grid.on_both_sides(found, rule_grid.rule_count(SPECS, 2))


@query(f"WITH {RULES_SQL} SELECT rule_id, side, a || CASE WHEN b >= 0 THEN ',' || b ELSE '' END AS spec_ids, n AS n_events, round(mean, 6) AS mean_return FROM ({SIDES_SQL})")
def rule_grid_support(spark, sf_dir):
    """Events and mean return of every rule of one or two conditions over all grids, thresholds and comparisons."""
    _, _, rules = _grown(spark, sf_dir)
    return rules.select("rule_id", "side", F.concat_ws(",", F.col("spec_ids").cast("array<string>")).alias("spec_ids"), "n_events", r("mean_return"))


def _best(specs: DataFrame, rules: DataFrame) -> DataFrame:
    pairs = rules.filter(F.size("spec_ids") == 2).withColumn("mean_return", F.round("mean_return", 9))
    return rule_grid.best_of_indicators(pairs, specs, LEAST)


@query(f"WITH {RULES_SQL}, {BEST_SQL} SELECT rule_id, side, x.symbol, x.bar FROM best JOIN h x ON x.spec_id = a JOIN h z ON z.spec_id = b AND z.symbol = x.symbol AND z.bar = x.bar")
def rule_grid_events(spark, sf_dir):
    """The bars of the best rule of every two indicators, by words ANDed."""
    words, specs, rules = _grown(spark, sf_dir)
    best = _best(specs, rules).select("rule_id", "side", "spec_ids")
    return rule_grid.event_bars(rule_grid.event_words(words, best)).join(best.select("rule_id", "side"), "rule_id").select("rule_id", "side", "symbol", "bar")
