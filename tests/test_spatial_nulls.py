"""Bootstrap weights, executor-made nulls and the three-target analysis against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import nulls, pattern, weights
from cohortloom.operators.linear import ranks, residuals
from cohortloom.plans import catalogue_spatial, spatial


@pytest.mark.parametrize(("n", "size"), [(1, 4), (4, 4), (37, 4), (1030, 1024)])
def test_weights_are_one_multinomial_however_rows_are_dealt(spark, n, size):
    whole = np.concatenate([weights.block_weights(k, n, 30, 5, size) for k in range(-(-n // size))], axis=1)
    assert whole.shape == (30, n) and (whole.sum(axis=1) == n).all()
    got = np.zeros((30, n), int)
    for r in weights.weights(spark, n, 30, 5, size).collect():
        assert r.weight > 0 and not got[r.draw, r.row_pos]
        got[r.draw, r.row_pos] = r.weight
    assert (got == whole).all()


def test_weights_have_the_multinomial_s_moments():
    w = np.concatenate([weights.block_weights(k, 40, 20_000, 7, 8) for k in range(5)], axis=1)
    assert w.mean() == 1 and w.var(axis=0) == pytest.approx(np.full(40, 1 - 1 / 40), abs=0.05)
    c = np.corrcoef(w.T)
    assert np.abs(c - np.eye(40) + (1 - np.eye(40)) / 39).max() < 0.04


def test_component_draws_equal_repeated_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 6)) * [3, 1, 1, 1, 1, 1]
    x = x - x.mean(axis=1, keepdims=True)
    f = pattern.first_component(x)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row_pos long, z array<double>").repartition(3)
    got = {r.draw: r for r in weights.component_draws(rows, f["loading"], f["centre"], 50, 25, 9, 8).collect()}
    w = np.concatenate([weights.block_weights(k, 50, 25, 9, 8) for k in range(7)], axis=1)
    assert sorted(got) == list(range(25))
    for draw, r in got.items():
        want = pattern.first_component(np.repeat(x, w[draw], axis=0))
        sign = np.sign(want["loading"] @ f["loading"])
        assert np.allclose(r.loading, want["loading"] * sign, atol=1e-8) and r.eigen1 == pytest.approx(want["eigen1"])
        assert r.cosine == pytest.approx(abs(want["loading"] @ f["loading"])) and not r.degenerate
    flat = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "row_pos long, z array<double>")
    told = weights.component_draws(flat, np.array([1.0, 0.0]), np.array([1.0, 2.0]), 5, 3, 1).collect()
    assert len(told) == 3 and all(r.degenerate and r.loading is None for r in told)
    with pytest.raises(Exception, match="finite"):
        weights.component_draws(spark.createDataFrame([(0, [1.0, float("nan")])], "row_pos long, z array<double>"), np.ones(2), np.zeros(2), 1, 2, 1).collect()


def atlas(n=10, seed=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    coords = np.vstack([v, v * [-1, 1, 1]])
    return coords, rng.normal(size=2 * n), rng.normal(size=(2 * n, 2)), rng.normal(size=(2 * n, 2))


def test_nulls_keep_what_they_must_and_are_made_again(spark):
    coords, x, targets, gradients = atlas()
    w = spatial.graph_weights(coords[:10], 3)
    z = pattern.nuisance(gradients, 10)
    for plan, t in ((nulls.hemispheres(x, w), targets), (nulls.conditional(x, z, np.kron(np.eye(2), w)), residuals(ranks(targets), z))):
        told = {r.draw: r for r in nulls.null_statistics(spark, plan, t, 600, 11).collect()}
        maps, seen = nulls.maps_of(plan, np.arange(600), 11), nulls.observed_statistics(plan, t)
        assert sorted(told) == list(range(600))
        for d in (0, 1, 255, 256, 599):
            assert told[d].r == pytest.approx([np.corrcoef(maps[d], c)[0, 1] for c in t.T]) and told[d].norm2 == pytest.approx(seen["norm2"]) and told[d].moran == pytest.approx(seen["moran"])
            assert told[d].nuisance < 1e-9
        m = plan.components.shape[1]  # 2 ** m maps are possible
        assert len(np.unique(np.round(maps, 9), axis=0)) > 0.9 * 2**m * (1 - (1 - 2.0**-m) ** 600)
    e = residuals(ranks(x), z)
    assert nulls.observed_statistics(plan, t)["r"] == pytest.approx([np.corrcoef(e, c)[0, 1] for c in t.T])


def test_degenerate_maps_and_large_atlases_are_refused():
    coords, x, targets, gradients = atlas()
    with pytest.raises(pattern.Degenerate):
        nulls.correlations(np.ones((1, 20)), targets)
    assert np.isnan(nulls.correlations(np.ones((1, 20)), targets, hard=False)).all()
    with pytest.raises(pattern.Degenerate):
        nulls.conditional(gradients[:, 0], pattern.nuisance(gradients, 10), np.kron(np.eye(2), spatial.graph_weights(coords[:10], 3)))
    with pytest.raises(ValueError):
        nulls.Plan(np.zeros(5000), np.zeros(5000), np.zeros((5000, 1)))


def test_spins_are_permutations_within_hemispheres(spark):
    coords, x, targets, _ = atlas()
    rows = nulls.spin_statistics(spark, coords, x, targets, 40, 3, 4).collect()
    assert len(rows) == 40 and all(r.valid for r in rows)
    perm = nulls.spin(coords, nulls.rotation(7, 3))
    assert {r.draw: r.r for r in rows}[7] == pytest.approx([np.corrcoef(x[perm], t)[0, 1] for t in targets.T])
    turn = nulls.rotation(7, 3)
    assert np.allclose(turn @ turn.T, np.eye(3)) and np.linalg.det(turn) == pytest.approx(1)
    assert (nulls.spin(coords, np.eye(3)) == np.arange(20)).all()


def three(spark, inferential=True, boots=40, draws=99):
    rng = np.random.default_rng(8)
    coords, _, receptors, gradients = atlas()
    regions = [f"r{k}" for k in range(24)]
    x = np.log(np.exp(rng.normal(size=(30, 24)) * 0.1 + np.outer(rng.normal(size=30), np.linspace(-1, 1, 24))))
    x = x - x.mean(axis=1, keepdims=True)
    original = np.linspace(-1, 1, 24)
    ix = list(rng.permutation(24)[:20])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row_pos long, z array<double>")
    out = spatial.three_targets(rows, regions, ("r20", "r21"), original, spatial.Atlas(ix, coords, gradients, receptors), boots, draws, inferential=inferential)
    return out, x, ix, original, coords, gradients, receptors


def test_three_targets_against_brute_force(spark):
    out, x, ix, original, coords, gradients, receptors = three(spark)
    f = pattern.first_component(x)
    load = f["loading"] * np.sign(f["loading"][[20, 21]].mean())
    assert [r.loading for r in out["pattern"].collect()] == pytest.approx(load.tolist())
    z, targets = pattern.nuisance(gradients, 10), np.column_stack([original[ix], receptors])
    held = residuals(ranks(receptors), z)

    def judged(v):
        rest = residuals(ranks(v[ix]), z)
        return [*(np.corrcoef(v[ix], t)[0, 1] for t in targets.T), *(np.corrcoef(rest, h)[0, 1] for h in held.T), v @ original / np.linalg.norm(original)]

    w = weights.block_weights(0, 30, 40, spatial.SEEDS["bootstrap"])
    draws = []
    for k in range(40):
        v = pattern.first_component(np.repeat(x, w[k], axis=0))["loading"]
        draws.append(judged(v * np.sign(v @ load)))
    draws = np.array(draws)
    rows = {(r.analysis, r.target): r for r in out["effects"].collect()}
    names = [*(("primary", t) for t in spatial.TARGETS), *(("gradient", t) for t in spatial.GRADIENT_TARGETS), ("cosine", "original_pattern")]
    assert set(rows) == set(names)
    for k, name in enumerate(names):
        r = rows[name]
        assert r.observed == pytest.approx(judged(load)[k]) and r.n_finite == 40
        assert (r.q025, r.median, r.q975) == pytest.approx(tuple(np.quantile(draws[:, k], [0.025, 0.5, 0.975])), abs=1e-7)
        if k < 3:
            assert r.expected_direction == pytest.approx(np.mean(draws[:, k] * spatial.DIRECTIONS[k] > 0))
        else:
            assert r.expected_direction is None
    wmean = (spatial.graph_weights(coords[:10]) + spatial.graph_weights(coords[10:])) / 2
    for key, plan, t, cols in (("primary", nulls.hemispheres(load[ix], wmean), targets, slice(0, 3)), ("gradient", nulls.conditional(load[ix], z, np.kron(np.eye(2), wmean)), held, slice(3, 5))):
        seed = spatial.SEEDS["msr" if key == "primary" else "conditional"]
        null = nulls.correlations(nulls.maps_of(plan, np.arange(99), seed), t)
        seen = np.array(judged(load)[cols])
        p = (1 + (np.abs(null) >= np.abs(seen) - 1e-12).sum(axis=0)) / 100
        order = np.argsort(p, kind="stable")
        adjusted = np.empty(len(p))
        adjusted[order] = np.minimum(1, np.maximum.accumulate(p[order] * np.arange(len(p), 0, -1)))
        family = {r.target: r for r in out[f"{key}_family"].collect()}
        for k, name in enumerate([n for a, n in names if a == key]):
            assert (family[name].p, family[name].q) == pytest.approx((p[k], adjusted[k]))
        told = {r.quantity: r for r in out[f"{key}_diagnostics"].collect()}
        assert set(told) == {"norm", "nuisance", "cosine"} | {f"k{k}_{n}" for k in (3, 5, 8) for n in ("global", "R", "L")}
        assert told["norm"].min == pytest.approx(told["norm"].original) == pytest.approx(told["norm"].max)
        # the first keeps each half's own, the second that of the whole
        for name in ("k5_R", "k5_L") if key == "primary" else ("k5_global",):
            assert told[name].min == pytest.approx(told[name].original, abs=1e-9) and told[name].max == pytest.approx(told[name].original, abs=1e-9)


def test_branches_and_refusals(spark):
    out = three(spark, inferential=False, boots=5)[0]
    assert set(out) == {"pattern", "effects"}
    rows = spark.createDataFrame([(k, [float(k), -float(k), 0.1 * k * k, 0.0]) for k in range(5)], "row_pos long, z array<double>")
    regions = ["a", "b", "c", "d"]
    one, two = spatial.fit_branch(rows, "original", regions, ("a", "b")), spatial.fit_branch(rows, "external", regions, ("a", "c"))
    assert one["loading"][np.argmax(np.abs(one["loading"]))] > 0 and two["loading"][[0, 2]].mean() > 0
    for branch, names in (("other", regions), ("external", ["a", "a", "c", "d"]), ("external", ["a", "b"])):
        with pytest.raises(ValueError):
            spatial.fit_branch(rows, branch, names, ("a", "b"))
    with pytest.raises(ValueError):
        spatial.fit_branch(rows.limit(2), "external", regions, ("a", "b"))
    with pytest.raises(ValueError):
        spatial.Atlas([0, 0], np.zeros((2, 3)), np.zeros((2, 2)), np.zeros((2, 2)))


def test_queries_run_all_their_draws(spark):
    d = "/root/testdata/sf0.001"
    boot = catalogue_spatial.q_pc1_bootstrap(spark, d)
    assert boot.count() == catalogue_spatial.BOOTS and not boot.where("degenerate").count()
    spun = catalogue_spatial.q_spin(spark, d).first()
    assert spun.draws == spun.valid == catalogue_spatial.DRAWS and 0 < spun.p <= 1
    rows = catalogue_spatial.q_three_targets(spark, d).collect()
    assert len(rows) == 6 and sum(r.p is not None for r in rows) == 5 and all(r.q >= r.p for r in rows if r.p is not None)


def test_maps_and_draws_stay_in_executors(spark):
    """What a plan has is draws that tasks make and statistics: no table of draws, no null map, no collected matrix."""
    coords, x, targets, _ = atlas()
    told = nulls.null_statistics(spark, nulls.hemispheres(x, spatial.graph_weights(coords[:10], 3)), targets, 9999, 1)
    plan = told.agg(F.max("norm2"))._jdf.queryExecution().executedPlan().toString()
    assert "Range (0, 9999" in plan and "LocalTableScan" not in plan
