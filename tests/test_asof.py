"""As-of join against a loop."""

import random

import pytest

from tickloom.operators.asof import asof_join


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_equals_a_loop(spark, direction):
    draw = random.Random(3)
    right = [(draw.choice("ab"), draw.randrange(40), draw.randrange(1000)) for _ in range(30)] + [("a", None, 5)]
    left = [(draw.choice("abc"), draw.randrange(45), i) for i in range(60)] + [("a", None, 99), (None, 3, 98)]
    got = asof_join(
        spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, v int"), ["k"], "t", ["v"], direction
    ).collect()

    def near(k, t):
        fits = [(r[1], r[2]) for r in right if None not in (k, t, r[1]) and r[0] == k and (r[1] <= t if direction == "backward" else r[1] >= t)]
        return max(fits, default=(0, None))[1] if direction == "backward" else max(((-a, v) for a, v in fits), default=(0, None))[1]

    assert {r["i"]: r["v"] for r in got} == {i: near(k, t) for k, t, i in left} and len(got) == len(left)
