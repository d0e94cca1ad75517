"""Threshold conditions, rules, their events, and similarity of rules."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.functions.stretches import in_order, stretched
from candleforge.operators.indicators import LOOKBACK, REGISTRY, SparkOps, grid_values, instance_key

#: indicator, parameters, operator and threshold of each condition. Fixed values.
SPECS = (
    ("rsi", {"period": 14}, ">", 55.0),
    ("rsi", {"period": 14}, "<", 45.0),
    ("bb_pctb", {"n": 20}, ">", 0.8),
    ("bb_pctb", {"n": 20}, "<", 0.2),
    ("donchian_pos", {"period": 14}, ">", 0.7),
    ("close_pos_in_bar", {}, ">", 0.6),
    ("range_expansion", {"period": 10}, ">", 1.2),
)
DEPTH = 3


def spec_values(bars: DataFrame, specs=SPECS) -> DataFrame:
    """Bars with one column for each distinct indicator of the conditions: each is computed once for all rules."""
    ops = SparkOps(stretched(bars, LOOKBACK + 1))
    columns = {}
    for name, params, _, _ in specs:
        columns.setdefault(instance_key(name, params), ops.keep(REGISTRY[name].formula(ops, **params)))
    return ops.df.select("symbol", "t", (F.col("_bar") + 1).alias("bar"), "_stretch", "_own", *[c.alias(k) for k, c in columns.items()])


def hits(bars: DataFrame, specs=SPECS, shift: int = 1) -> DataFrame:
    """(spec_id, symbol, t, bar) at which each condition holds; shifted, a hit acts on the next bar."""
    values = spec_values(bars, specs)
    # One pass: every bar is unpacked to the numbers of the conditions that it meets.
    met = F.array(*[F.when(F.coalesce(F.expr(f"`{instance_key(n, p)}` {op} {th}D"), F.lit(False)), F.lit(i)) for i, (n, p, op, th) in enumerate(specs)])
    if shift:
        values = values.withColumn("met", F.lag(met, shift).over(in_order())).filter("met IS NOT NULL")
    else:
        values = values.withColumn("met", met)
    return values.filter("_own").select(F.explode(F.array_compact("met").cast("array<long>")).alias("spec_id"), "symbol", "t", F.col("bar").cast("long").alias("bar"))


def expanded_counts(bars: DataFrame, thresholds: dict[str, tuple[float, ...]]) -> DataFrame:
    """Bars that meet each condition of the expansion: every grid point of an indicator, threshold and operator."""
    found = None
    for name, cuts in thresholds.items():
        met = [F.when(F.col("value") < c if op == "<" else F.col("value") > c, F.struct(F.lit(op).alias("op"), F.lit(c).alias("threshold"))) for c in cuts for op in "<>"]
        own = grid_values(bars, name).select("instance", F.explode(F.array_compact(F.array(*met))).alias("c"))
        own = own.groupBy("instance", "c.op", "c.threshold").agg(F.count("*").alias("n"))
        found = own if found is None else found.unionByName(own)
    return found


def spec_sets(specs=SPECS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Sets of conditions on distinct indicators, in order."""
    names = sorted({s[0] for s in specs}, key=[s[0] for s in specs].index)
    by_name = {n: [i for i, s in enumerate(specs) if s[0] == n] for n in names}
    return [ids for d in range(1, depth + 1) for group in combinations(names, d) for ids in product(*(by_name[n] for n in group))]


def rules(spark: SparkSession, specs=SPECS, depth: int = DEPTH) -> DataFrame:
    """Conjunctions of conditions on distinct indicators, numbered in order, on both sides."""
    sets = spec_sets(specs, depth)
    rows = [(i, side, list(ids), " AND ".join(f"{instance_key(specs[k][0], specs[k][1])}{specs[k][2]}{specs[k][3]:g}" for k in ids)) for i, (ids, side) in enumerate(product(sets, ("LONG", "SHORT")))]
    return spark.createDataFrame(rows, "rule_id long, side string, spec_ids array<long>, label string")


def events(rule_rows: DataFrame, hit_rows: DataFrame) -> DataFrame:
    """(rule_id, symbol, t, bar) at which all conditions of a rule hold. The rules are a small table of fixed size."""
    wanted = F.broadcast(rule_rows.select("rule_id", F.size("spec_ids").alias("need"), F.explode("spec_ids").alias("spec_id")))
    found = hit_rows.join(wanted, "spec_id").groupBy("rule_id", "symbol", "t", "bar").agg(F.count("*").alias("have"), F.max("need").alias("need"))
    return found.filter("have = need").select("rule_id", "symbol", "t", "bar")


def words(hit_rows: DataFrame) -> DataFrame:
    """Hits packed to 64-bit words: bar % 64 of word bar div 64."""
    word = F.floor(F.col("bar") / 64).cast("long").alias("word")
    return hit_rows.groupBy("spec_id", "symbol", word).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bar % 64 AS INT))")).alias("bits"))


def jaccard(word_rows: DataFrame, least: float = 0.0) -> DataFrame:
    """Similarity of each pair of conditions, by AND of words; sizes bound it, so far-off pairs aren't compared."""
    sizes = word_rows.groupBy("spec_id").agg(F.sum(F.bit_count("bits")).alias("n"))
    a = word_rows.selectExpr("spec_id AS a", "symbol", "word", "bits AS x")
    b = word_rows.selectExpr("spec_id AS b", "symbol", "word", "bits AS y")
    common = a.join(b, ["symbol", "word"]).filter("a < b").groupBy("a", "b").agg(F.sum(F.bit_count(F.col("x").bitwiseAND(F.col("y")))).alias("both"))
    rows = common.join(sizes.selectExpr("spec_id AS a", "n AS na"), "a").join(sizes.selectExpr("spec_id AS b", "n AS nb"), "b")
    rows = rows.filter(F.least("na", "nb") >= least * F.greatest("na", "nb"))
    return rows.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard")).filter(F.col("jaccard") >= least)


def greedy(ids: list, near: set[tuple], most: int | None = None) -> list:
    """Ids in order, each kept if it is near none kept before; ``near`` has pairs in either order."""
    kept: list = []
    for i in ids:
        if not any((i, k) in near or (k, i) in near for k in kept):
            kept.append(i)
        if most and len(kept) == most:
            break
    return kept
