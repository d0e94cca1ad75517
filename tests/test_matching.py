import random

import pytest

from candleforge.operators import matching


@pytest.mark.parametrize("interval", [0, 3, 10, 1000])
def test_one_to_one_equals_the_greedy_pass(spark, interval):
    rng = random.Random(interval)
    later = [(rng.choice("aab"), rng.randrange(120), i) for i in range(150)] + [(None, 3, 900), ("a", None, 901)]
    earlier = [(rng.choice("aab"), rng.randrange(120), 1000 + i) for i in range(130)] + [(None, 3, 1900)]
    used, want = set(), set()
    for k, t, i in sorted((x for x in later if None not in x), key=lambda x: (x[1], x[2])):
        free = sorted((u, j) for q, u, j in earlier if q == k and j not in used and u <= t <= u + interval)
        if free:
            used.add(free[0][1])
            want.add((i, free[0][1]))
    frames = [spark.createDataFrame(rows, "key string, at long, id long").repartition(5) for rows in (later, earlier)]
    assert {tuple(r) for r in matching.one_to_one(*frames, interval).collect()} == want
    assert matching.one_to_one(frames[0], frames[1].limit(0), interval).count() == 0
