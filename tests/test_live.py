"""Positions of a symbol's ticks against a walk over all of them."""

import random

import pandas as pd
import pytest

from candleforge.streaming import live


class State:
    exists = False

    def update(self, value):
        self.get, self.exists = value, True


def walk(rows, tp, sl, most):
    entry, held, out = 0.0, 0, []
    for ts, _, price in sorted(rows):
        if entry <= 0:
            entry, held = price, 0
            continue
        held += 1
        move = (price / entry - 1) * 100
        reason = "TP" if move >= tp else "SL" if move <= -sl else "TIMEOUT" if held >= most else None
        if reason:
            out.append(("a", entry, price, reason, held, ts))
            entry, held = 0.0, 0
    return out


@pytest.mark.parametrize("slice_", [7, 10_000])
def test_positions_leave_by_slices(monkeypatch, slice_):
    monkeypatch.setattr(live, "SLICE", slice_)
    rng, state, got = random.Random(4), State(), []
    start = pd.Timestamp("2024-01-01")
    rows = [(start + pd.Timedelta(seconds=i // 3), i, 50 + rng.random() * 30) for i in range(500)]
    for part in (rows[:300], rows[300:]):
        mixed = rng.sample(part, len(part))
        frames = [pd.DataFrame(mixed[i : i + 40], columns=["ts", "seq", "price"]).assign(symbol="a") for i in range(0, len(mixed), 40)]
        out = list(live.positions("a", iter(frames), state, 15.0, 15.0, 9))
        assert max(len(x) for x in out) <= slice_
        got += [tuple(r) for x in out for r in x[["symbol", "entry", "exit", "reason", "held", "ts"]].itertuples(index=False)]
    assert got == walk(rows, 15.0, 15.0, 9) and {r[3] for r in got} == {"TP", "SL", "TIMEOUT"}
