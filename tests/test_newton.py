"""Distributed logistic fits, calibration and profile bounds against the kernels of one group."""

import numpy as np
import pytest
from cohortloom.operators import linear, newton


def data(spark, seed=1, n=160):
    rng = np.random.default_rng(seed)
    rows, kept = [], {}
    for g in (None, "a", "b"):
        x1, x2 = rng.normal(size=n) * 2 + 5, (rng.random(n) < 0.3).astype(float)
        y = (rng.random(n) < 1 / (1 + np.exp(-(-2 + 0.4 * x1 + 0.8 * x2)))).astype(int)
        kept[g] = np.column_stack([np.ones(n), x1, x2]), y
        rows += [(g, int(y[k]), 1.0, float(x1[k]), float(x2[k])) for k in range(n)]
    return rows, kept


SCHEMA = "g string, y int, one double, x1 double, x2 double"


def test_fits_equal_the_kernel(spark):
    rows, kept = data(spark)
    rows += [("one class", 1, 1.0, float(k), 0.0) for k in range(9)]
    rows += [("apart", int(k > 4), 1.0, float(k), float(k % 2)) for k in range(9)]
    rows += [("copy", k % 2, 1.0, float(k), float(k)) for k in range(9)]
    rows += [("zero", k % 2, 1.0, float((k * 7) % 5), 0.0) for k in range(9)]
    rows += [("gap", k % 2, 1.0, None if k else 1.0, 0.5 * k) for k in range(9)]
    got = {r.g: r for r in newton.fits(spark.createDataFrame(rows, SCHEMA), ["g"], "y", ["one", "x1", "x2"]).collect()}
    for g, (x, y) in kept.items():
        b, value, info = linear.logistic(x, y)
        assert got[g].status == "ok" and got[g].beta == pytest.approx(b.tolist(), abs=1e-7) and got[g].value == pytest.approx(-value)
        assert got[g].info == pytest.approx(info.ravel().tolist(), rel=1e-5)
    assert {g: got[g].status for g in ("one class", "apart", "copy", "zero", "gap")} == {"one class": "single class", "apart": "separated", "copy": "rank", "zero": "ok", "gap": "rank"}
    assert got["zero"].beta[2] == 0
    assert newton.fits(spark.createDataFrame([], SCHEMA), ["g"], "y", ["one", "x1", "x2"]).count() == 0


def test_calibration_equals_the_kernel(spark):
    rng = np.random.default_rng(5)
    rows, kept = [], {}
    for g in ("a", "b"):
        p = rng.random(200)
        y = (rng.random(200) < p**1.5).astype(int)
        kept[g] = linear.calibrate(y, p)
        rows += [(g, int(a), float(b)) for a, b in zip(y, p)]
    rows += [("one class", 1, 0.1 * k) for k in range(9)] + [("flat", k % 2, 0.5) for k in range(8)] + [("apart", int(k > 3), 0.1 * k + 0.05) for k in range(9)] + [("gap", k % 2, None if k == 3 else 0.1 * k) for k in range(9)] + [("ends", k % 2, float(k > 4)) for k in range(10)]
    got = {r.g: r for r in newton.calibration(spark.createDataFrame(rows, "g string, y int, p double"), ["g"]).collect()}
    for g, want in kept.items():
        assert got[g].status == want["status"] == "ESTIMABLE"
        assert (got[g].offset, got[g].intercept, got[g].slope) == pytest.approx((want["offset"], want["intercept"], want["slope"]), abs=1e-6)
    assert {g: got[g].status for g in ("one class", "flat", "apart", "gap")} == {"one class": "NOT_ESTIMABLE_SINGLE_CLASS", "flat": "CONSTANT_PREDICTIONS_SLOPE_NOT_ESTIMABLE", "apart": "UNSTABLE_OR_SEPARATED", "gap": "UNSTABLE_OR_SEPARATED"}
    assert got["flat"].offset == pytest.approx(0, abs=1e-8) and got["flat"].slope is None and got["ends"].status == "ESTIMABLE"


def test_profile_bounds_equal_the_kernel(spark):
    rows, kept = data(spark, 7)
    rows += [("apart", int(k > 4), 1.0, float(k), float(k % 2)) for k in range(12)] + [("one class", 0, 1.0, float(k), 0.0) for k in range(9)] + [("zero", k % 2, 1.0, 0.0, float((k * 7) % 5)) for k in range(9)]
    got = {r.g: r for r in newton.profile(spark.createDataFrame(rows, SCHEMA), ["g"], "y", ["one", "x1", "x2"], "x1").collect()}
    for g, (x, y) in kept.items():
        want = linear.profile_interval(x, y, 1)
        assert got[g].status == want["status"] == "estimated"
        assert (got[g].log_or, got[g].lo, got[g].hi, got[g].lr, got[g].p) == pytest.approx((want["log_or"], want["lo"], want["hi"], want["lr"], want["p"]), abs=1e-6)
    assert got["apart"].status == "nonestimable_separation" and got["one class"].status.startswith("not estimable") and got["zero"].status == "a bound isn't reached"
    assert all(got[g].lo is None and got[g].p is None for g in ("apart", "one class", "zero"))


def test_groups_are_summed_and_not_collected(spark):
    """A round's figures come from partial sums of rows; Python has a row a group."""
    rows, _ = data(spark)
    df = newton._numeric(spark.createDataFrame(rows, SCHEMA), ["g"], "y", ["one", "x1", "x2"], None)
    plan = newton._figures(df, ["g"], 3, newton._beginning(df, ["g"], 3))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Pandas" not in plan and "Python" not in plan
