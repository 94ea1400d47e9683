"""Exact quantiles against numpy, over columns that narrow well and badly."""

import math
import random

import numpy as np
import pytest

from sievekit.operators import quantile as Q

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def columns(n):
    rnd = random.Random(5)
    return {
        "uniform": [rnd.random() for _ in range(n)],
        "counts": [rnd.randint(0, 6) for _ in range(n)],
        "constant": [7.25] * n,
        "two": [rnd.choice([-1e308, 1e308]) for _ in range(n)],
        "powers": [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 300) for _ in range(n)],
        "close": [1 + rnd.randint(0, 10 ** 6) * 2.0 ** -52 for _ in range(n)],
        "skewed": [rnd.choice([0.0] * 9 + [rnd.expovariate(1)]) for _ in range(n)],
        "holes": [rnd.choice([None, math.nan, rnd.gauss(0, 1)]) for _ in range(n)],
        "none": [None] * n,
    }


@pytest.mark.parametrize("few, buckets", [(256, 1024), (1, 8)])
def test_equals_numpy(spark, monkeypatch, few, buckets):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BUCKETS", buckets)
    for n in (1, 2, 5, 900):
        data = columns(n)
        df = spark.createDataFrame([tuple(float(v[i]) if v[i] is not None else None for v in data.values()) for i in range(n)],
                                   ", ".join(f"`{c}` double" for c in data)).cache()
        got = Q.quantiles(df, list(data), PROBS)
        for c, values in data.items():
            held = [v for v in values if v is not None and not math.isnan(v)]
            if not held:
                assert got[c] is None
            elif c in ("two", "powers"):  # interpolation of huge values: the ranks around are what counts
                place = [(len(held) - 1) * p for p in PROBS]
                whole = sorted(held)
                assert all(g == whole[int(p)] for g, p in zip(got[c], place) if p == int(p))
            else:
                assert np.allclose(got[c], np.quantile(held, PROBS), rtol=1e-12, atol=0)


def test_empty_table(spark):
    assert Q.quantiles(spark.createDataFrame([], "a double"), ["a"], PROBS) == {"a": None}
