"""Rules from grids against plain Python over the indicators' own values."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from candleforge.operators import rule_grid
from candleforge.operators.indicators import grid_values

NAMES = ("close_pos_in_bar", "rsi", "donchian_pos", "open_close_momentum")


def candles(spark, n=400):
    price = 100 + 10 * F.sin(F.col("i") / 9.0) + (F.col("i") * 7919 % 31) / 10.0
    rows = spark.range(n).withColumnRenamed("id", "i").withColumn("symbol", F.when(F.col("i") % 3 == 0, "A").otherwise("B"))
    close = price + (F.col("i") * 104729 % 17) / 10.0 - 0.8
    return rows.select(
        "symbol", (F.col("i") * 3600).alias("t"), F.when(F.col("i") == 200, None).otherwise(price).alias("open"),
        (F.greatest(price, close) + 0.3).alias("high"), (F.least(price, close) - 0.2).alias("low"), close.alias("close"), F.lit(1.0).alias("volume"),
    )


@pytest.fixture(scope="module")
def world(spark):
    """Conditions, their words in stretches of different lengths, and the bars each meets, by plain Python."""
    bars, specs = candles(spark), rule_grid.expansion(NAMES)
    order, place = {}, {}
    for x in sorted(bars.collect(), key=lambda x: x["t"]):
        own = order.setdefault(x["symbol"], [])
        place[x["symbol"], x["t"]] = len(own)
        own.append((x["close"] / x["open"] - 1) * 100 if x["open"] else None)
    met = {s.spec_id: set() for s in specs}
    for name in NAMES:
        for x in grid_values(bars, name).collect():
            bar = place[x["symbol"], x["t"]] + 1
            if x["value"] is None or bar >= len(order[x["symbol"]]) or order[x["symbol"]][bar] is None:
                continue
            for s in specs:
                if s.instance == x["instance"] and (x["value"] > s.threshold if s.op == ">" else x["value"] < s.threshold):
                    met[s.spec_id].add((x["symbol"], bar))
    return specs, rule_grid.spec_table(spark, specs), rule_grid.signal_words(bars, specs, length=128), met, order


def expected(met, order, sets):
    both = {ids: set.intersection(*(met[i] for i in ids)) for ids in sets}
    return {ids: (len(bars), sum(order[s][b] for s, b in bars)) for ids, bars in both.items()}


def sets_of(specs, depth):
    """Sets of so many conditions of distinct indicators, by indicators and then by points."""
    rows = [tuple(s.spec_id for s in c) for c in combinations(specs, depth) if len({s.place for s in c}) == depth]
    return sorted(rows, key=lambda ids: ([specs[i].place for i in ids], ids))


def same(rows, wanted):
    found = {tuple(x["spec_ids"]): (x["n_events"], x["total"]) for x in rows}
    assert len(found) == len(rows) and found.keys() == wanted.keys()
    for ids, (n, total) in wanted.items():
        assert found[ids][0] == n and found[ids][1] == pytest.approx(total, abs=1e-9)


def test_singles_and_pairs(world):
    specs, table, words, met, order = world
    one = rule_grid.singles(words, table)
    same(one.collect(), expected(met, order, sets_of(specs, 1)))
    same(rule_grid.grown(words, table, one.select("spec_ids")).collect(), expected(met, order, sets_of(specs, 2)))


def test_blocks_and_free_growth(world, spark, monkeypatch):
    """Left rules of several blocks, grown by any other indicator: sets that two of them lead to come once."""
    specs, table, words, met, order = world
    monkeypatch.setattr(rule_grid, "BLOCK", 3)
    pairs = sets_of(specs, 2)[:: len(sets_of(specs, 2)) // 8]
    lefts = spark.createDataFrame([(list(p),) for p in pairs], "spec_ids array<long>")
    wanted = {tuple(sorted((*p, s.spec_id))) for p in pairs for s in specs if s.place not in {specs[i].place for i in p}}
    same(rule_grid.grown(words, table, lefts, later=False).collect(), expected(met, order, wanted))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_numbers_of_rules(spark, depth):
    specs = rule_grid.expansion(NAMES)
    sets, before = sets_of(specs, depth), rule_grid.rule_count(specs, depth - 1)
    rows = spark.createDataFrame([(list(ids), before + i) for i, ids in enumerate(sets)], "spec_ids array<long>, wanted long")
    assert rule_grid.place_of_rule(specs, rule_grid.spec_table(spark, specs), rows).filter("NOT rule_no <=> wanted").count() == 0
    assert rule_grid.rule_count(specs, depth) == before + len(sets)


def test_events(world, spark):
    specs, _, words, met, _ = world
    sets = sets_of(specs, 3)[::997]
    rules = spark.createDataFrame([(i, list(ids)) for i, ids in enumerate(sets)], "rule_id long, spec_ids array<long>")
    found = {(x["rule_id"], x["symbol"], x["bar"]) for x in rule_grid.event_bars(rule_grid.event_words(words, rules)).collect()}
    assert found == {(i, *at) for i, ids in enumerate(sets) for at in set.intersection(*(met[k] for k in ids))}
    assert found


def test_empty_table(spark):
    specs = rule_grid.expansion(NAMES[:1])
    table, words = rule_grid.spec_table(spark, specs), rule_grid.signal_words(candles(spark, 0), specs)
    assert [(x["n_events"], x["total"]) for x in rule_grid.singles(words, table).collect()] == [(0, 0.0)] * len(specs)
