"""Percentiles beside a sort of all values."""

import random

import pytest

from heddle.operators import evaluate


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_rank(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 7.0, float(rng.randint(0, 40))])) for _ in range(600)] + [("empty", None), ("one", 3.0)]
    got = {r["key"]: tuple(r)[1:] for r in evaluate.nearest_rank(spark.createDataFrame(rows, "key string, value double"), "key", "value", (50, 95)).collect()}
    want = {}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        want[key] = (len(values), *[values[-(-p * len(values) // 100) - 1] if values else None for p in (50, 95)])
    assert got == want
