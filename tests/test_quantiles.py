"""Exact quantiles by selection against NumPy."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortloom.operators import metrics
from cohortloom.operators.quantiles import quantiles

PROBS = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


def check(spark, groups, by=("g",)):
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: r for r in quantiles(df, "v", list(by), PROBS).collect()}
    assert set(got) == {g for g, vs in groups.items() if vs}
    for g, r in got.items():
        fine = [v for v in groups[g] if v is not None and math.isfinite(v)]
        assert r.n == len(fine)
        assert r.q is None if not fine else r.q == pytest.approx(np.quantile(fine, PROBS).tolist(), rel=1e-12, abs=1e-300)


def test_groups_of_all_shapes(spark):
    rng = np.random.default_rng(1)
    check(spark, {
        "normal": rng.normal(size=5000).tolist(),
        "one value": [3.5] * 3000,
        "ties": rng.integers(0, 4, 4000).astype(float).tolist(),
        "far": [*rng.normal(size=999).tolist(), 1e300, -1e300],
        "tiny": (rng.normal(size=800) * 1e-300).tolist(),
        "mixed sign": [-0.0, 0.0, -1.0, 1.0, *(rng.normal(size=50) * 10.0 ** rng.integers(-9, 9, 50)).tolist()],
        "odd": [1.0, None, math.nan, math.inf, -math.inf, 2.0],
        "none": [None, math.nan],
        "single": [7.0],
        None: [1.0, 2.0, 4.0],
    })


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=True, allow_infinity=True, width=32), min_size=1, max_size=60))
def test_any_values(spark, values):
    check(spark, {"a": values})


def test_no_groups_and_bad_probabilities(spark):
    df = spark.createDataFrame([(None, float(k)) for k in range(11)], "g string, v double")
    r = quantiles(df, "v", [], [0.5, 0.1]).collect()
    assert len(r) == 1 and r[0].n == 11 and r[0].q == [5.0, 1.0]
    assert quantiles(df.where("false"), "v", ["g"], [0.5]).count() == 0
    for bad in ([], [1.5]):
        with pytest.raises(ValueError):
            quantiles(df, "v", ["g"], bad)


def test_bounded_and_unbounded_agree(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(str(k % 3), float(v)) for k, v in enumerate(rng.normal(size=300))], "g string, v double")
    for f in (metrics.percentile_interval, metrics.distribution):
        a, b = ({r.g: tuple(r)[1:] for r in f(df, "v", ["g"], bounded).collect()} for bounded in (True, False))
        assert all(a[g] == pytest.approx(b[g]) for g in a) and set(a) == set(b)


def test_no_task_has_a_group(spark):
    """No percentile buffer; the only window over a whole group is that over its buckets' counts."""
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    plan = quantiles(df, "v", ["g"], [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_c#" in w or "_t__in" in w or "_bucket" in w for w in windows)
