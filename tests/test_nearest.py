"""Nearest neighbours by cells against all pairs."""

import numpy as np
import pytest

from cohortloom.operators import spatial


def brute(rows, k, d):
    out = set()
    for g, p, *x in rows:
        if x is None or not np.isfinite(np.array(x, float)).all():
            continue
        others = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x, y)))), q) for h, q, *y in rows if h == g and q != p and np.isfinite(np.array(y, float)).all())
        out |= {(g, p, q, f"{dist:.8g}", r + 1) for r, (dist, q) in enumerate(others[:k])}
    return out


def found(df):
    return {(r.g, r.src, r.dst, f"{r.distance:.8g}", r["rank"]) for r in df.collect()}


@pytest.mark.parametrize(("d", "k"), [(1, 3), (2, 4), (3, 5), (5, 2)])
def test_equals_all_pairs(spark, d, k):
    rng = np.random.default_rng(d)
    shapes = {
        "even": rng.random((60, d)),
        "dense and far": np.vstack([rng.normal(size=(50, d)) * 1e-4, rng.normal(size=(8, d)) * 1e5, np.full((1, d), 1e7)]),
        "line": np.repeat(np.arange(40.0)[:, None], d, axis=1),
        "few": rng.random((2, d)),
        "one": rng.random((1, d)),
        "copies": np.vstack([np.zeros((12, d)), np.ones((3, d)), rng.random((5, d))]),
        None: rng.integers(0, 3, (40, d)).astype(float),
    }
    rows = [(g, int(n), *map(float, x)) for g, xs in shapes.items() for n, x in enumerate(xs)]
    names = tuple("xyzuv"[:d])
    df = spark.createDataFrame(rows, "g string, pos long, " + ", ".join(f"{c} double" for c in names))
    assert found(spatial.nearest(df, k, ["g"], coords=names)) == brute(rows, k, d)


def test_points_that_are_nowhere_are_left_out(spark):
    rows = [("a", 1, 0.0, 0.0, 0.0), ("a", 2, 1.0, 0.0, 0.0), ("a", 3, float("nan"), 0.0, 0.0), ("a", 4, 3.0, 0.0, 0.0)]
    df = spark.createDataFrame([*rows, ("a", 5, None, 0.0, 0.0)], "g string, pos long, x double, y double, z double")
    assert found(spatial.nearest(df, 2, ["g"])) == brute(rows, 2, 3)
    assert spatial.nearest(df.where("false"), 2, ["g"]).count() == 0


def test_no_join_of_all_points_of_a_group(spark):
    """Every join has the cell, or the place, among its keys."""
    df = spark.createDataFrame([("a", k, float(k), 0.0, 1.0) for k in range(50)], "g string, pos long, x double, y double, z double")
    got = spatial.nearest(df, 3, ["g"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Cross" not in plan
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert any("_level" in j and "_g_f" in j for j in joins)


def test_only_pairs_within_a_bound_go_on(spark):
    """Where places meet, pairs farther apart than the k nearest can be are left out; they are not dealt first."""
    rng = np.random.default_rng(8)
    even = [("even", k, *map(float, x)) for k, x in enumerate(rng.random((300, 3)))]
    grid = [("grid", k, float(k % 6), float(k // 6 % 6), float(k // 36)) for k in range(216)]
    copies = [("copies", k, float(k % 20), 1e6 * (k % 3), -1.0) for k in range(200)]
    rows = even + grid + copies
    df = spark.createDataFrame(rows, "g string, pos long, x double, y double, z double")
    got = spatial.nearest(df, 5, ["g"])
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "_g_f" in line]
    assert joins and all("_reach" in j for j in joins)
    assert found(got) == brute(rows, 5, 3)
