"""All draws of the bridge by blocks of people, against the tables of draws and people."""

import os

import numpy as np
import pytest

from cohortloom.operators import drawn, pattern, weights
from cohortloom.plans import bridge

COLUMNS = "age double, female double, scanner double, t1 double, t2 double, r0 double, r1 double"
DESIGNS = ({"a": (["age"], ["t1", "t2"]), "b": (["age", "female", "scanner"], ["t1", "t2"])}, {"p": ["age"], "q": ["age", "scanner", "t1", "t2"]}, ["r0", "r1"], ["age"], ["female", "scanner"])


def _study(spark, n, rng, copies):
    z = rng.normal(size=(n, 5)) * [3, 1, 1, 1, 1]
    z[rng.permutation(n)[:copies]] = z[0]
    x = np.column_stack([rng.normal(size=n).round(1), rng.random(n) < 0.5, np.arange(n) % 2, np.arange(n) % 3 == 1, np.arange(n) % 3 == 2, z[:, 0] + rng.normal(size=n), rng.integers(0, 5, n)]).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-0.5 * z[:, 0]))).astype(int)
    rows = [(k, z[k].tolist(), int(y[k]), *x[k].tolist()) for k in range(n)]
    return z, spark.createDataFrame(rows, f"row_pos long, z array<double>, y int, {COLUMNS}").repartition(3)


@pytest.mark.parametrize("part", [16, 40, 1000])
def test_blocks_equal_tables_of_draws_and_people(spark, tmp_path, part):
    rng = np.random.default_rng(part)
    n, draws, seed, size = 90, 150, 4, 16
    z, study = _study(spark, n, rng, 20)
    f = pattern.first_component(z)
    load = f["loading"] * pattern.sign_by_largest(f["loading"])
    loadings = weights.component_draws(study, load, f["centre"], n, draws, seed, size)
    known = drawn.known_draws(loadings, f["centre"], n, draws, seed, 2.0, bridge.BUNDLE, size, part)
    assert known.parts == -(-n // part)
    got = {(r.draw, r.quantity): r for r in bridge.block_draws(study, known, *DESIGNS, f"file://{tmp_path}/blocks").collect()}
    # distinct people's scores are the same where their vectors are: rounded, so that sums in another order tie too
    scores = bridge.draw_scores(study, loadings, n, draws, seed, 2.0, f"file://{tmp_path}/u", size)
    want = bridge.adjusted_draws(scores.selectExpr("draw", "row_pos", "weight", "round(score, 10) AS score"), study.drop("z"), *DESIGNS, f"file://{tmp_path}/tables").collect()
    assert len(got) == len(want) == draws * (6 + 2 + 4) and {r.status for r in want} == {"PASS"}
    for r in want:
        found = got[r.draw, r.quantity]
        assert found.status == "PASS" and found.value == pytest.approx(r.value, abs=1e-7), r


def test_failed_fits_of_blocks_have_their_reason(spark, tmp_path):
    n, draws = 30, 3
    z = np.random.default_rng(2).normal(size=(n, 3))
    w = weights.block_weights(0, n, draws, 5)
    # a value that isn't finite, of a person whom a draw leaves out
    out = next(k for k in range(n) if (w[1:, k] == 0).sum() == 1)
    has = int(1 + np.flatnonzero(w[1:, out])[0])
    rows = [(k, z[k].tolist(), 1, float(k), 0.0, 0.0, 3.0, float("nan") if k == out else float(k % 7)) for k in range(n)]
    study = spark.createDataFrame(rows, "row_pos long, z array<double>, y int, a double, t1 double, t2 double, r0 double, r1 double")
    loadings = spark.createDataFrame([(d, [1.0, 0.0, 0.0] if d else None) for d in range(draws)], "draw long, loading array<double>")
    known = drawn.known_draws(loadings, np.zeros(3), n, draws, 5, 1.0, bridge.BUNDLE)
    got = {(r.draw, r.quantity): r for r in bridge.block_draws(study, known, {"a": (["a"], ["t1", "t2"])}, {"p": ["a"], "odd": ["r1"]}, ["r0"], ["a"], [], f"file://{tmp_path}/1").collect()}
    assert {d for d, _ in got} == {1, 2} and all(r.value is None for r in got.values())
    assert {got[d, "a_type_1"].status for d in (1, 2)} == {"rank"} and {got[d, "p_response"].status for d in (1, 2)} == {"single class"}
    assert {got[d, "raw_r0"].status for d in (1, 2)} == {"ValueError: a ranking has no spread"}
    assert got[has, "odd_response"].status == "rank" and got[3 - has, "odd_response"].status == "single class"
    got = {(r.draw, r.quantity): r for r in bridge.block_draws(study, known, {}, {}, ["r1"], ["a"], [], f"file://{tmp_path}/2").collect()}
    assert got[has, "raw_r1"].status == got[has, "partial_r1"].status == "ValueError: a value isn't finite"
    assert got[3 - has, "raw_r1"].status == "PASS" and abs(got[3 - has, "raw_r1"].value) <= 1


def test_equal_vectors_score_alike_in_any_block():
    rng = np.random.default_rng(3)
    z, loadings = rng.normal(size=(300, 64)), rng.normal(size=(200, 64))
    whole = drawn.projected(z, loadings)
    assert np.allclose(whole, loadings @ z.T) and all(np.array_equal(drawn.projected(z[k : k + 1], loadings)[:, 0], whole[:, k]) for k in (0, 7, 299))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables aren't there")
def test_the_bridge_has_all_draws_of_the_reference(spark):
    from cohortloom.plans.catalogue import QUERIES

    rows = QUERIES["q_bridge_intervals"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 13 and {(r.total, r.enough, r.ordered) for r in rows} == {(2000, True, True)}
