import hashlib
import random

import numpy as np
import pytest

from candleforge.operators import exits, null_screen


def series(n: int, symbol: str, seed: int):
    rng = random.Random(seed)
    rows, close = [], 100.0
    for t in range(n):
        open_ = close * (1 + rng.gauss(0, 0.01))
        close = open_ * (1 + rng.gauss(0, 0.02))
        high, low = max(open_, close) * (1 + abs(rng.gauss(0, 0.01))), min(open_, close) * (1 - abs(rng.gauss(0, 0.01)))
        times = [None if rng.random() < 0.2 else 3600 * t + 60 * rng.randrange(60) for _ in range(2)]
        rows.append((symbol, 3600 * t, *(round(x, 2) for x in (open_, high, low, close)), 1.0, *times))
        close = rows[-1][5]
    return rows


COLUMNS = "symbol string, t long, open double, high double, low double, close double, volume double, high_time long, low_time long"


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(series(150, "x", 1) + series(40, "y", 2), COLUMNS).cache()


def sign(seed: int, t: int) -> int:
    return 1 if hashlib.md5(f"{seed}:{t}".encode()).hexdigest()[0] < "8" else -1


@pytest.mark.parametrize("length", [7, 1000])
def test_synthetic_paths_equal_a_loop(spark, bars, length):
    decimals = spark.createDataFrame([("x", 2), ("y", 2)], "symbol string, decimals long")
    got = {(r.seed, r.symbol, r.t): r for r in null_screen.synthetic(bars, spark.range(5, 8).withColumnRenamed("id", "seed"), decimals, length).collect()}
    assert len(got) == 3 * 190
    for seed in (5, 6, 7):
        for rows in (series(150, "x", 1), series(40, "y", 2)):
            before = path = rows[0][2]
            for symbol, t, o, h, low, c, _, ht, lt in rows:
                s = sign(seed, t)
                ro, rc = (path * (x / before) ** s for x in (o, c))
                rh, rl = (path * ((h if s > 0 else low) / before) ** s, path * ((low if s > 0 else h) / before) ** s)
                own = got[seed, symbol, t]
                assert own.open == pytest.approx(ro, abs=0.0051) and own.close == pytest.approx(rc, abs=0.0051)
                assert own.high == pytest.approx(max(rh, ro, rc), abs=0.0051) and own.low == pytest.approx(min(rl, ro, rc), abs=0.0051)
                assert (own.high_time, own.low_time) == ((ht, lt) if s > 0 else (lt, ht))
                before, path = c, rc
    # All symbols share a time's sign.
    assert {s: len({sign(s, 3600 * t) for t in range(40)}) for s in (5, 6, 7)} == {5: 2, 6: 2, 7: 2}


def outcome(rows, i, tp, sl, horizon, side):
    entry, sign_ = rows[i][5], 1 if side == "LONG" else -1
    if i + horizon >= len(rows):
        return None
    for _, _, _, h, low, _, _, ht, lt in rows[i + 1 : i + horizon + 1]:
        win = tp > 0 and (h >= entry * (1 + tp / 100) if sign_ > 0 else low <= entry * (1 - tp / 100))
        lose = sl > 0 and (low <= entry * (1 - sl / 100) if sign_ > 0 else h >= entry * (1 + sl / 100))
        if win or lose:
            first = None not in (ht, lt) and (ht < lt if sign_ > 0 else lt < ht)
            res = tp if win and (not lose or first) else -sl
            break
    else:
        res = sign_ * (rows[i + horizon][5] / entry - 1) * 100
    return res - 0.005 * (2 + sign_ * res / 100)


def test_grid_targets_equal_a_scan(bars):
    configs = [(3.0, 2.0, 5), (0.0, 4.0, 9), (0.0, 0.0, 3)]
    got = {(r.symbol, r.t, r.target): r.y for r in exits.grid_targets(bars, configs).collect()}
    want = {}
    for rows in (series(150, "x", 1), series(40, "y", 2)):
        for i, row in enumerate(rows):
            for k, config in enumerate(configs):
                for j, side in enumerate(("LONG", "SHORT")):
                    y = outcome(rows, i, *config, side)
                    if y is not None:
                        want[row[0], row[1], 2 * k + j] = pytest.approx(y, abs=1e-9)
    assert got == want


def test_rectangles_equal_masks(spark):
    rng = np.random.default_rng(4)
    n, cuts = 700, [1, 2]
    codes, y = rng.integers(-1, 3, (n, 2)), rng.normal(0, 1, n)
    codes[:, 1] = np.where(rng.random(n) < 0.1, -1, rng.integers(0, 5, n))
    rows = spark.createDataFrame([("x", i, codes[i].tolist(), [float(y[i]) if i % 9 else None]) for i in range(n)], "symbol string, bar long, bins array<int>, y array<double>")
    shifts = spark.createDataFrame([("x", n, "null", 0, 37), ("x", n, "real", 0, 0)], "symbol string, n long, kind string, draw int, shift long")
    got = null_screen.rectangle_edges(null_screen.shifted_histograms(rows, shifts, [(0, 1)]), cuts).collect()
    want = {}
    for kind, k in (("null", 37), ("real", 0)):
        for moved in "ab":
            at = np.arange(n)
            a, b = codes[(at + k) % n if moved == "a" else at, 0], codes[(at + k) % n if moved == "b" else at, 1]
            valid = (a >= 0) & (b >= 0) & (at % 9 != 0)
            mean, sd, total = y[valid].mean(), y[valid].std(), valid.sum()
            for ca in range(1):
                for sa in "<>":
                    for cb in range(2):
                        for sb in "<>":
                            in_a = valid & (a < 2 * ca + 1 if sa == "<" else a > 2 * ca + 1)
                            in_b = valid & (b < 2 * cb + 1 if sb == "<" else b > 2 * cb + 1)
                            both = in_a & in_b
                            m = both.sum()
                            if m >= 30 and total - m >= 30:
                                edge = (y[both].mean() - mean) / (max(y[both].std(), sd) / np.sqrt(m))
                                want[kind, moved, ca, sa, cb, sb] = (m, pytest.approx(edge), bool(in_a.sum() - m >= 30 and in_b.sum() - m >= 30))
    assert {(r.kind, r.moved, r.cut_a, r.side_a, r.cut_b, r.side_b): (r.n, r.edge, r.valid) for r in got} == want
    assert want


def test_shifts_are_disjoint_and_in_range(spark):
    sizes = spark.createDataFrame([("x", 90), ("y", 30)], "symbol string, n long")
    rows = null_screen.drawn_shifts(sizes, 15, 20, 40).collect()
    assert {r.symbol for r in rows} == {"x"}
    null, pilot = ([r.shift for r in rows if r.kind == k] for k in ("null", "pilot"))
    assert len(null) == 40 and len(set(pilot)) == 20 and not set(null) & set(pilot)
    assert all(15 <= s <= 75 for s in null + pilot)


def test_pick_is_the_largest_excess_over_the_floor(spark):
    rows = spark.createDataFrame([("s", "i", 0, 3.0, 1.0), ("s", "i", 1, 2.5, 9.0), ("s", "i", 2, 1.0, 50.0), ("t", "i", 0, 1.0, 1.0)], "symbol string, indicator string, cut int, z double, excess double")
    floor = spark.createDataFrame([("s", "i", 2.0, 1.0, 1.5), ("t", "i", 2.0, 1.0, 1.5)], "symbol string, indicator string, floor double, med double, p84 double")
    got = {r.symbol: r for r in null_screen.picked(rows, floor, ["symbol", "indicator"], ["symbol", "indicator", "cut"]).collect()}
    assert (got["s"].T, got["s"].passed, got["s"].cut, got["s"].excess, got["s"].score) == (3.0, True, 1, 9.0, 4.0)
    assert (got["t"].T, got["t"].passed, got["t"].cut) == (1.0, False, None)


def test_screen_finds_planted_memory_only(spark):
    """A symbol whose next moves follow its last one passes, one of independent moves has a T near the null's."""
    rng = np.random.default_rng(11)

    def path(memory: float, symbol: str):
        moves, out, close = [0.0], [], 100.0
        for t in range(500):
            moves.append(memory * moves[-1] + rng.normal(0, 0.02))
            open_, close = close, close * np.exp(moves[-1])
            out.append((symbol, 3600 * t, open_, max(open_, close) * 1.001, min(open_, close) * 0.999, close, 1.0, None, None))
        return out

    rows = spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in path(0.95, "trend") + path(0.0, "noise")], COLUMNS)
    got = {r.symbol: r for r in null_screen.screen(rows, {"rsi": [44.73, 55.31]}, [(0.0, 0.0, 3)], pilots=30, paths=30).collect()}
    assert got["trend"].passed and got["trend"].score > 2
    assert got["noise"]["T"] < got["trend"]["T"] / 2
