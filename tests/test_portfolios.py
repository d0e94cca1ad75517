"""Sets, subperiods, scores and ranks of portfolios against plain Python."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from candleforge.operators import portfolios, trades
from candleforge.plans import catalog, portfolio

GROUPS = ["1H-L", "1H-S", "4H-L", "4H-L", "1H-L", "4H-L", "1H-S"]


@pytest.fixture(scope="module")
def ids(spark):
    rows = [(f"id{i}", g) for i, g in enumerate(GROUPS)]
    return portfolios.numbered_ids(spark.createDataFrame(rows, "id string, grp string"))


def numbers(least, most, groups):
    sets = [c for k in range(least, most + 1) for c in combinations(range(len(groups)), k) if {groups[i] for i in c} == set(groups)]
    return {sum(1 << i for i in c): len(c) for c in sets}


@pytest.mark.parametrize(("least", "most"), [(2, 3), (2, 5), (4, 7), (3, 3)])
def test_sets_cover_groups(ids, least, most):
    found = portfolios.covering_sets(ids, least, most).collect()
    assert len(found) == len({x["combo"] for x in found})
    assert {x["combo"]: x["size"] for x in found} == numbers(least, most, GROUPS)


def test_sets_without_rules(spark):
    one = portfolios.numbered_ids(spark.createDataFrame([(f"i{i}", "all") for i in range(6)], "id string, grp string"))
    assert {x["combo"]: x["size"] for x in portfolios.covering_sets(one, 2, 4).collect()} == numbers(2, 4, ["all"] * 6)


def test_subperiods_step_back_by_calendar():
    day = lambda text: (pd.Timestamp(text) - pd.Timestamp("1970-01-01")).days
    first, last = day("2020-01-10"), day("2021-05-31")
    wanted, at = [pd.Timestamp("2021-05-31")], pd.Timestamp("2021-05-31")
    while (at - pd.DateOffset(months=3) - pd.Timestamp("2020-01-10")).days >= 3 * portfolios.DAYS_A_MONTH:
        at = at - pd.DateOffset(months=3)
        wanted.append(at)
    found = portfolios.subperiods(first, last, 3)
    assert [a for a, _ in found] == [first, *[day(x) for x in wanted[::-1][:-1]]]
    assert found[-1][1] == last and all(b + 1 == a for (_, b), (a, _) in zip(found, found[1:], strict=False))
    assert portfolios.weights(1) == [1.0] and sum(portfolios.weights(4)) == pytest.approx(1, abs=1e-5) and portfolios.weights(4)[-1] == 0.5


def by_hand(members, rows, begin, end, metric):
    own = rows[(rows.day >= begin) & (rows.day <= end)]
    days = range(own.day.min(), own.day.max() + 1)
    there = [m for m in members if (own[own.idx == m].profit != 0).any()]
    if not there:
        return None
    gains = own[own.idx.isin(there)].groupby("day").profit.sum().reindex(days, fill_value=0.0).to_numpy()
    base = portfolios.CAPITAL * len(there)
    equity = base + np.cumsum(gains)
    if equity[-1] <= base:
        return None
    fall = ((equity - np.maximum.accumulate(equity)) / np.maximum.accumulate(equity) * 100).min()
    gain = (equity[-1] - base) / base * 100
    if metric == "r2":
        moved = np.flatnonzero(gains)
        part = equity[moved[0] : moved[-1] + 1]
        value = np.corrcoef(np.arange(len(part)), part)[0, 1] ** 2 if len(part) > 1 else None
    else:
        value = {"net_gain": gain, "max_drawdown": -abs(fall), "calmar": gain / abs(fall) if fall < 0 else None}[metric]
    return None if value is None else round(float(value), 3)


@pytest.mark.parametrize("metric", portfolios.METRICS)
def test_scores_and_ranks(spark, ids, metric):
    rng = np.random.default_rng(7)
    rows = pd.DataFrame({"idx": rng.integers(0, 6, 150), "day": rng.integers(100, 400, 150), "profit": rng.normal(4, 30, 150).round(2)})
    rows = rows.groupby(["idx", "day"], as_index=False).profit.sum()
    spans = [(100, 199), (200, 299), (300, 399), (900, 999)]
    sets = portfolios.covering_sets(ids, 4, 6)
    found = portfolios.ranked(portfolios.scored(sets, spark.createDataFrame(rows), spans, metric), parts=4).toPandas().set_index("combo")
    assert set(found.index) == set(numbers(4, 6, GROUPS)) and "s3" not in found.columns
    total = pd.Series(0.0, index=found.index)
    for i, (begin, end) in enumerate(spans[:3]):
        wanted = {c: by_hand([k for k in range(7) if c >> k & 1], rows, begin, end, metric) for c in found.index}
        for c, value in wanted.items():
            got = found.loc[c, f"s{i}"]
            assert pd.isna(got) if value is None else got == pytest.approx(value, abs=0.00101)
        order = sorted((c for c in found.index if not pd.isna(found.loc[c, f"s{i}"])), key=lambda c: (-found.loc[c, f"s{i}"], c))
        ranks = {c: k + 1 for k, c in enumerate(order)}
        assert all(found.loc[c, f"r{i}"] == ranks.get(c, len(found)) for c in found.index)
        total += found[f"r{i}"] * portfolios.weights(3)[i]
    assert np.allclose(total, found["weighted_rank"])


def test_daily_profit_reads_trades_once(spark):
    rows = [("a", 4, 1.0), ("a", 4, 2.0), ("a", 13, 5.0), ("b", 20, -1.0), ("a", None, 9.0), (None, 5, 9.0), ("b", 21, None)]
    frame = spark.createDataFrame(rows, "strategy string, sell_day long, profit double").repartition(2)
    daily = trades.daily_profit(frame)
    at = lambda day: (day - 4) // 7 * 5 + min((day - 4) % 7, 4)
    want = [("a", i, {0: 3.0, at(13): 5.0}.get(i, 0.0)) for i in range(at(13) + 1)] + [("b", i, -1.0 if i == at(20) else 0.0) for i in range(at(20), at(21) + 1)]
    assert sorted(map(tuple, daily.collect())) == want
    assert "Join" not in daily._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("module", "query"), [(catalog, "portfolio_rank"), (portfolio, "portfolio_subperiods")])
def test_lines_and_orders_are_joined_once(spark, tmp_path, monkeypatch, module, query):
    """What the queries read after the daily profits are stored does not hold the trades."""
    real = trades.trades
    spark.createDataFrame([(i, i % 5, 1 + i % 2, float(100 + i % 7), 0.0, "AR"[i % 2], "F", 9000 + i * 7, 8990 + i * 7) for i in range(60)], "k int, p int, n int, price double, disc double, flag string, status string, ship int, day int").createOrReplaceTempView("made")
    text = "SELECT {} FROM made"
    spark.sql(text.format("CAST(k AS BIGINT) l_orderkey, n l_linenumber, price l_extendedprice, 0.04 + k % 3 * 0.02 l_discount, 0.0 l_tax, 1.0 l_quantity, flag l_returnflag, status l_linestatus, date_add(DATE '1970-01-01', ship) l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql(text.format("CAST(k AS BIGINT) o_orderkey, concat(p, '-X') o_orderpriority, date_add(DATE '1970-01-01', day) o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    count = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(module.trades, "trades", lambda *of: real(*of).mapInArrow(seen, real(*of).schema))
    assert catalog.QUERIES[query](spark, str(tmp_path)).count() > 0
    assert count.value == 60
