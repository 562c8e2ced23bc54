"""Exact medians by narrowing ranges, against Python's, with nothing written."""

import math
import random
import statistics

from duewise.operators import ordering
from duewise.operators.ordering import exact_medians


def want(values):
    own = [v for v in values if v is not None and not math.isnan(v)]
    return len(own), statistics.median(own) if own else None


def test_medians_of_odd_columns(spark, monkeypatch):
    def stage(*_):
        raise AssertionError("the medians wrote a copy of the values")

    monkeypatch.setattr(ordering, "stage", stage)
    rng, n = random.Random(3), 401
    inf, nan = math.inf, math.nan
    columns = {
        "uniform": [rng.uniform(-5, 9) for _ in range(n)],
        "even": [rng.uniform(-5, 9) for _ in range(n - 1)] + [None],
        "ties": [float(rng.randrange(3)) for _ in range(n)],
        "one": [7.5] * n,
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 308) for _ in range(n)],
        "ends": [rng.choice([-1.7e308, 1.7e308, 1.0, 2.0, inf, -inf]) for _ in range(n)],
        "close": [1000.0 + rng.randrange(50) * 2**-40 for _ in range(n)],
        "outlier": [1e15 if i == 0 else rng.random() for i in range(n)],
        "tiny": [rng.randrange(1, 9) * 5e-324 for _ in range(n)],
        "zeros": [rng.choice([0.0, -0.0]) for _ in range(n)],
        "missing": [rng.choice([None, nan, rng.random()]) for _ in range(n)],
        "none": [None] * n,
        "whole": [float(rng.randrange(-(10**9), 10**9)) for _ in range(n)],
        "two": [1.0, 4.0] + [None] * (n - 2),
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{c}` double" for c in columns))
    for buckets in (64, 4096):
        got = {r["name"]: (r["values"], r["median"]) for r in exact_medians(df, list(columns), buckets).collect()}
        assert got == {c: want(v) for c, v in columns.items()}
    assert exact_medians(df, []).count() == 0
