"""Property tests (hypothesis): exact operators equal their definitions on random inputs."""

from __future__ import annotations

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortlens.operators import evaluate as E
from cohortlens.operators import ordered as O

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

values = st.lists(
    st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
    min_size=1,
    max_size=300,
)


@SETTINGS
@given(xs=values)
def test_exact_quantiles_equal_numpy(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r.prob: r.value for r in O.exact_quantiles(df, ["v"], probs).collect()}
    for p in probs:
        assert math.isclose(got[p], float(np.percentile(np.array(xs), p * 100)), rel_tol=1e-12, abs_tol=1e-9)


scores = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20).map(lambda k: k / 20)), min_size=2, max_size=200)


@SETTINGS
@given(rows=scores)
def test_auc_equals_pair_count(spark, rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    df = spark.createDataFrame([("m", y, p) for y, p in rows], "model string, y int, p double")
    got = E.auc(df, ["model"], "y", "p").first().auc
    if not pos or not neg:
        assert got is None
        return
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(got, want, rel_tol=1e-12, abs_tol=1e-12)
