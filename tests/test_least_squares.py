"""Distributed least squares against the kernel of one group, and the states of groups that can't be fitted."""

import numpy as np
import pytest

from cohortloom.operators import least_squares, linear


def groups(spark, seed=3, n=70):
    rng = np.random.default_rng(seed)
    rows, kept = [], {}
    for g in (None, "a", "b"):
        y = (rng.random(n) < 0.4).astype(float)
        a, b = rng.normal(size=n) * 3 + 100, (rng.random(n) < 0.5).astype(float)
        v = 5 + 0.7 * y - 0.02 * a + rng.standard_t(4, size=n) * (1 + y)
        kept[g] = np.column_stack([np.ones(n), y, a, b]), v, y
        rows += [(g, int(k), float(v[k]), int(y[k]), float(a[k]), float(b[k])) for k in range(n)]
    return spark.createDataFrame(rows, "g string, row_pos long, v double, y int, a double, b double"), kept


def test_equals_the_kernel_of_one_group(spark):
    df, kept = groups(spark)
    got = {r.g: r for r in least_squares.associations(df, ["g"], "v", "y", ["a", "b"]).collect()}
    for g, (x, v, y) in kept.items():
        f, sd = linear.hc3(x, v), linear.pooled_sd(v, y)
        i = linear.influence(x, v, sd)
        r = got[g]
        want = {"estimate": f["beta"][1], "se": f["se"][1], "lo": f["lo"][1], "hi": f["hi"][1], "p": f["p"][1], "standardized": f["beta"][1] / sd, "max_cooks": i["max_cooks"], "max_leverage": i["max_leverage"], "loo_min": i["loo_min"], "loo_max": i["loo_max"], "sign_changes": i["sign_changes"], "n": len(v)}
        assert {k: r[k] for k in want} == pytest.approx(want, rel=1e-8)


def test_influence_rows_equal_refits(spark):
    df, kept = groups(spark, 4, 40)
    got = {(r.g, r.row_pos): r for r in least_squares.influence_rows(df, ["g"], "v", "y", ["a", "b"]).collect()}
    for g, (x, v, y) in kept.items():
        f, sd = linear.hc3(x, v), linear.pooled_sd(v, y)
        loo, vif = linear.leave_one_out(x, v) / sd, linear.inflation(x)[0]
        for k in range(len(v)):
            r = got[g, k]
            assert (r.coefficient, r.change, r.leverage, r.cooks, r.vif) == pytest.approx((loo[k], loo[k] - f["beta"][1] / sd, f["leverage"][k], f["cooks"][k], vif), rel=1e-7, abs=1e-9)
            assert r.sign_changed == (np.sign(loo[k]) != np.sign(f["beta"][1]))


def test_groups_that_cannot_be_fitted_say_why(spark):
    def group(name, y, a, v):
        return [(name, k, v[k], y[k], a[k]) for k in range(len(y))]

    v = [1.0, 2.0, 4.0, 3.0, 7.0, 5.0]
    rows = group("ok", [0, 1, 0, 1, 0, 1], [1.0, 2.0, 3.0, 5.0, 4.0, 9.0], v)
    rows += group("few", [0, 1, 0], [1.0, 2.0, 4.0], v) + group("one class", [1] * 6, [1.0, 2.0, 3.0, 5.0, 4.0, 9.0], v)
    rows += group("copy", [0, 1, 0, 1, 0, 1], [0.0, 1.0, 0.0, 1.0, 0.0, 1.0], v) + group("gap", [0, 1, 0, 1, 0, 1], [1.0, None, 3.0, 5.0, 4.0, 9.0], v)
    rows += group("alone", [0, 0, 0, 0, 0, 1], [1.0, 2.0, 3.0, 5.0, 4.0, 9.0], v) + group("flat", [0, 1, 0, 1, 0, 1], [1.0, 2.0, 3.0, 5.0, 4.0, 9.0], [2.0] * 6)
    df = spark.createDataFrame(rows, "g string, row_pos long, v double, y int, a double")
    got = {r.g: r for r in least_squares.associations(df, ["g"], "v", "y", ["a"], with_status=True).collect()}
    want = {"ok": "ok", "few": "not estimable: rank", "one class": "not estimable: rank", "copy": "not estimable: rank", "gap": "not estimable: rank", "alone": "not estimable: leverage", "flat": "not estimable: deviation"}
    assert {g: r.status for g, r in got.items()} == want
    assert all((r.estimate is None) == (r.status != "ok") == (r.p is None) for r in got.values())
    per_row = least_squares.influence_rows(df, ["g"], "v", "y", ["a"], with_status=True).collect()
    assert len(per_row) == len(rows) and {r.g: r.status for r in per_row} == want
    with pytest.raises(Exception, match="not estimable"):
        least_squares.associations(df, ["g"], "v", "y", ["a"]).collect()
    assert least_squares.associations(df.where("false"), ["g"], "v", "y", ["a"]).count() == 0


def test_no_group_reaches_a_python_task(spark):
    """Only rows of groups, of p x p figures, go through Python: the plan groups by partial aggregation and maps, never by applyInPandas."""
    df, _ = groups(spark)
    plan = least_squares.associations(df, ["g"], "v", "y", ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan and "partial_sum" in plan
