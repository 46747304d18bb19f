"""Monotone bucket keys and exact quantiles on heavy-tailed data."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ivnflow.operators.profile import exact_quantiles
from ivnflow.operators.sampling import ordered_bucket

finite = st.floats(allow_nan=False, allow_infinity=False, min_value=-1e300, max_value=1e300)


@settings(max_examples=5, deadline=None)
@given(st.lists(finite, min_size=2, max_size=60))
def test_bucket_monotone(spark, xs):
    edge = [2.0 ** k * s for k in range(-30, 31, 7) for s in (1 - 1e-16, 1.0, 1 + 1e-15)]
    vals = sorted(set(xs + edge + [-e for e in edge] + [0.0]))
    rows = spark.createDataFrame([(v,) for v in vals], "x double") \
        .select("x", ordered_bucket("x").alias("k")).collect()
    keys = [r.k for r in sorted(rows, key=lambda r: r.x)]
    assert all(a <= b for a, b in zip(keys, keys[1:]))


def test_quantiles_heavy_tail(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros(3000), rng.pareto(1.1, 5000) * 1e-3, -rng.exponential(2.0, 500),
                        np.array([1e12, 7.5])])
    df = spark.createDataFrame([("f", float(v)) for v in x], "feature string, value double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = {r.q: r.quantile for r in exact_quantiles(df, qs).collect()}
    for q in qs:
        assert math.isclose(got[q], float(np.quantile(x, q)), rel_tol=1e-12, abs_tol=1e-15)
