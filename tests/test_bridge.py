"""The adjusted bridge against plain loops over repeated rows."""

import re

import numpy as np
import pytest

from cohortloom.operators import linear, pattern, weights
from cohortloom.plans import bridge


def test_adjusted_draws_equal_plain_loops(spark, tmp_path):
    rng = np.random.default_rng(21)
    n, draws, seed = 60, 12, 4
    z = rng.normal(size=(n, 5)) * [3, 1, 1, 1, 1]
    x = {"age": rng.normal(size=n).round(1), "female": (rng.random(n) < 0.5).astype(float), "scanner": (np.arange(n) % 2).astype(float), "t1": (np.arange(n) % 3 == 1).astype(float), "t2": (np.arange(n) % 3 == 2).astype(float), "r0": z[:, 0] + rng.normal(size=n), "r1": rng.integers(0, 5, n).astype(float)}
    y = (rng.random(n) < 1 / (1 + np.exp(-0.5 * z[:, 0]))).astype(int)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(z)], "row_pos long, z array<double>").repartition(3)
    cohort = spark.createDataFrame([(k, int(y[k]), *(float(c[k]) for c in x.values())) for k in range(n)], "row_pos long, y int, " + ", ".join(f"{c} double" for c in x))
    f = pattern.first_component(z)
    load = f["loading"] * pattern.sign_by_largest(f["loading"])
    loadings = weights.component_draws(rows, load, f["centre"], n, draws, seed, 16)
    folder = f"file://{tmp_path}"
    scores = bridge.draw_scores(rows, loadings, n, draws, seed, 2.0, folder, 16)
    told = bridge.adjusted_draws(scores, cohort, {"a": (["age"], ["t1", "t2"]), "b": (["age", "female", "scanner"], ["t1", "t2"])}, {"p": ["age"], "q": ["age", "scanner", "t1", "t2"]}, ["r0", "r1"], ["age"], ["female", "scanner"], folder)
    got = {(r.draw, r.quantity): r for r in told.collect()}
    w = np.concatenate([weights.block_weights(k, n, draws, seed, 16) for k in range(4)], axis=1)
    assert len(got) == draws * (6 + 2 + 4)
    for d in range(draws):
        at = np.repeat(np.arange(n), w[d])
        v = pattern.first_component(z[at])["loading"]
        v = v * np.sign(v @ load)
        s = (z[at] - z[at].mean(axis=0)) @ v / 2.0
        s = np.round(s, 12)  # copies tie
        take = lambda *names: np.column_stack([np.ones(len(at)), *[x[c][at] for c in names]])
        for name, cols in (("a", ["age"]), ("b", ["age", "female", "scanner"])):
            b = np.linalg.lstsq(take(*cols, "t1", "t2"), s, rcond=None)[0]
            assert [got[d, f"{name}_{q}"].value for q in ("type_1", "type_2", "type_difference")] == pytest.approx([b[-2], b[-1], b[-2] - b[-1]], abs=1e-7)
        for name, cols in (("p", ["age"]), ("q", ["age", "scanner", "t1", "t2"])):
            b = linear.logistic(np.column_stack([np.ones(len(at)), s, *[x[c][at] for c in cols]]), y[at])[0]
            assert got[d, f"{name}_response"].value == pytest.approx(b[1], abs=1e-6)
        ranked = linear.ranks(np.column_stack([s, x["r0"][at], x["r1"][at]]))
        design = np.column_stack([np.ones(len(at)), linear.ranks(x["age"][at]), x["female"][at], x["scanner"][at]])
        rest = linear.residuals(ranked, design)
        for k in (0, 1):
            assert got[d, f"raw_r{k}"].value == pytest.approx(np.corrcoef(ranked.T)[0, 1 + k], abs=1e-7)
            assert got[d, f"partial_r{k}"].value == pytest.approx(np.corrcoef(rest.T)[0, 1 + k], abs=1e-7)
    told = bridge.bridge_intervals(told, draws).collect()
    assert len(told) == 12 and all(r.valid == draws and r.scope.startswith("percentile over people") for r in told)


def test_failed_fits_are_counted_under_their_reason(spark, tmp_path):
    n, draws = 30, 3
    rng = np.random.default_rng(2)
    z = rng.normal(size=(n, 3))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(z)], "row_pos long, z array<double>")
    cohort = spark.createDataFrame([(k, 1, float(k), 0.0, 0.0, 3.0) for k in range(n)], "row_pos long, y int, a double, t1 double, t2 double, r0 double")
    loadings = spark.createDataFrame([(d, [1.0, 0.0, 0.0] if d else None) for d in range(draws)], "draw long, loading array<double>")
    folder = f"file://{tmp_path}"
    scores = bridge.draw_scores(rows, loadings, n, draws, 5, 1.0, folder)
    told = bridge.adjusted_draws(scores, cohort, {"a": (["a"], ["t1", "t2"])}, {"p": ["a"]}, ["r0"], ["a"], [], folder)
    got = told.collect()
    assert {r.draw for r in got} == {1, 2} and all(r.value is None and r.status != "PASS" for r in got)
    why = {r.quantity: r.status for r in bridge.failures(told).collect()}
    assert why["a_type_1"] == "rank" and why["p_response"] == "single class" and why["raw_r0"] == "ValueError: a ranking has no spread"


def test_ranks_go_to_their_bucket_once(spark):
    """Weighted average ranks with ties, and no join of rows with ranks by their values."""
    rng = np.random.default_rng(5)
    w, v, s = rng.integers(1, 4, (2, 40)), rng.integers(-3, 4, 40).astype(float), rng.normal(size=(2, 40))
    people = spark.createDataFrame([(d, k, int(w[d, k]), float(s[d, k]), float(v[k])) for d in range(2) for k in range(40)], "draw long, row_pos long, weight long, score double, r0 double")
    got = bridge.drawn_ranks(people, ["score", "r0"])
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any(re.search(r"\bv#\d+ = v#\d+", j) for j in joins)
    rows = {(r.draw, r.row_pos): r for r in got.collect()}
    for d in range(2):
        at = np.repeat(np.arange(40), w[d])
        for name, x in (("r_score", s[d]), ("r_r0", v)):
            ranks = dict(zip(at.tolist(), linear.ranks(x[at])))
            assert [rows[d, k][name] for k in range(40)] == pytest.approx([ranks[k] for k in range(40)])
            assert [rows[d, k].weight for k in range(40)] == w[d].tolist()
