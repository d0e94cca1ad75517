import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleforge.operators import multiple_testing, stats
from candleforge.sources.shared import Tables


def columns_of(spark, z, dev):
    rows = [(i, float(z[i]), [float(x) for x in dev[i]]) for i in range(len(z))]
    return spark.createDataFrame(rows, "col long, z double, deviation array<double>").repartition(3)


def sequential(z, dev, k, alpha):
    """The procedure over one matrix: adjusted p, and how many columns are rejected."""
    order = sorted(range(len(z)), key=lambda i: (-z[i], i))
    n, replicas, done, p = len(z), dev.shape[1], 0, {}
    while done < n:
        first = done - min(done, k - 1)
        suffix = np.sort(dev[order[first:]], axis=0)[::-1][min(k, n - first) - 1]
        own = {i: (suffix >= z[i]).sum() / replicas for i in order[done:]}
        rejected = [i for i in order[done:] if own[i] <= alpha]
        p |= {i: own[i] for i in rejected or order[done:]}
        done += len(rejected) or n
    most = np.maximum.accumulate([p[i] for i in order])
    return dict(zip(order, most.tolist(), strict=True)), int((most <= alpha).sum())


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(8)
    z = np.concatenate([rng.normal(0, 1, 45), rng.normal(4, 1.5, 15), [1.0, 1.0]])
    return z, rng.normal(0, 1, (62, 50))


@pytest.mark.parametrize("k", [1, 2, 7, 62, 90])
def test_step_down_equals_sequential(spark, matrix, k):
    z, dev = matrix
    want, _ = sequential(z, dev, k, 0.1)
    # Lists of three deviations have to grow.
    got = multiple_testing.step_down_pvalues(columns_of(spark, z, dev), "col", k, 0.1, m=3).collect()
    assert {r.col: round(r.p, 9) for r in got} == {i: round(x, 9) for i, x in want.items()}


def test_search_equals_all_k(spark, matrix):
    z, dev = matrix
    for gamma in (0.1, 0.3):
        k = next(k for k in range(1, 63) if sequential(z, dev, k, 0.1)[1] < k / gamma - 1)
        got = multiple_testing.false_discovery_pvalues(columns_of(spark, z, dev), "col", gamma, 0.1).collect()
        assert {r.k for r in got} == {k}
        assert {r.col: round(r.p, 9) for r in got} == {i: round(x, 9) for i, x in sequential(z, dev, k, 0.1)[0].items()}


def test_search_has_no_highest_level():
    """Where no level below 9,000 does, the first that does is found, and no level that could do is passed over."""

    class Counted(multiple_testing.StepDown):
        def __init__(self, rejects):
            self.rejects, self.tried = rejects, []

        def steps(self, k, *_):
            self.tried.append(k)
            return [k]

        def rejected(self, steps):
            return self.rejects(steps[0])

    for rejects in (lambda k: 100_000, lambda k: 90_000 + k, lambda k: 40 if k < 6 else 300 if k < 8 else 1000, lambda k: 0, lambda k: 25 * min(k, 20)):
        test = Counted(rejects)
        want = next(k for k in range(1, 200_000) if rejects(k) < k / 0.1 - 1)
        assert test.by_false_discoveries(0.1)[0] == want and len(test.tried) < 25


def test_one_column_and_best_of_each(spark, matrix):
    z, dev = matrix
    one = multiple_testing.step_down_pvalues(columns_of(spark, z[:1], dev[:1]), "col", 1, 0.1).collect()
    assert one[0].p == (dev[0] >= z[0]).mean()
    rows = spark.createDataFrame([("r", 1, 0.1, 0.05), ("r", 2, 0.3, 0.05), ("s", 1, 9.0, 0.2)], "rule string, combo long, z double, p double")
    assert sorted(map(tuple, multiple_testing.best_of_each(rows, "rule", "combo").collect())) == [("r", 2, 0.3, 0.05, True), ("s", 1, 9.0, 0.2, False)]


def test_hash_weights_and_deviations(spark):
    w = multiple_testing.hash_weights(23, 5, 40)
    assert w.shape == (40, 23) and (w.sum(axis=1) == 23).all() and len({tuple(x) for x in w}) > 35
    rng = np.random.default_rng(2)
    x = rng.normal(0.1, 1, (3, 23))
    rows = [(c, d, float(x[c, d])) for c in range(3) for d in range(23)]
    daily = spark.createDataFrame(rows, "col long, idx long, profit double")
    got = {r.col: r for r in stats.sharpe_deviations(daily, "col", 23, 0, 5, 40, multiple_testing.hash_weights).collect()}
    for c in range(3):
        mean, square = w @ x[c] / 23, w @ x[c] ** 2 / 23
        boot = mean / np.sqrt((square - mean**2) * 23 / 22)
        dev = boot - x[c].mean() / x[c].std(ddof=1)
        z = x[c].mean() / x[c].std(ddof=1) / dev.std(ddof=1)
        assert math.isclose(got[c].z, z, rel_tol=1e-9)
        assert np.allclose(got[c].deviation, dev / dev.std(ddof=1) + (z if z < -math.sqrt(2 * math.log(math.log(23))) else 0))


def test_columns_are_studied_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(c, d, float(rng.normal())) for c in range(40) for d in range(20)]
    daily = spark.createDataFrame(rows, "col long, idx long, profit double").repartition(1)
    want = {r.col: (r.z, r.deviation) for r in stats.sharpe_deviations(daily, "col", 20, 0, 3, 25).collect()}
    monkeypatch.setattr(stats, "TOGETHER", 150, raising=False)

    class Narrow:
        """Weights that meet no more numbers at once."""

        __array_ufunc__ = None

        def __init__(self, w):
            self.w = w

        @property
        def T(self):  # noqa: N802
            return self

        def __rmatmul__(self, x):
            assert len(x) * 25 <= 150
            return x @ self.w.T

    got = stats.sharpe_deviations(daily, "col", 20, 0, 3, 25, lambda *of: Narrow(stats.bootstrap_weights(*of))).collect()
    assert {r.col for r in got} == set(want) == set(range(40))
    for r in got:
        np.testing.assert_allclose([r.z, *r.deviation], [want[r.col][0], *want[r.col][1]], rtol=1e-9, atol=1e-12)


def test_tables_go_with_their_block(spark, tmp_path):
    with Tables(spark) as tables:
        kept, gone = tables.kept(spark.range(3)), tables.stored(spark.range(3))
        path = gone.inputFiles()[0]
    assert kept.count() == 3
    assert spark.range(1).select(F.lit(path)).first() and not spark._jvm.java.io.File(path.removeprefix("file://")).exists()
