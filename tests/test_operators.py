"""Golden cases and invariants of the cohort operators."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortloom.functions import columns as C
from cohortloom.functions import distributions as D
from cohortloom.operators import assembly, contracts, elastic_net, linear, metrics, pattern, ranking, regional, resampling, spatial, splits
from cohortloom.operators.contracts import ContractError


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def family(spark, ps):
    return spark.createDataFrame([("f", k, float(p)) for k, p in enumerate(ps)], "family string, k int, p double")


def test_bh_and_holm(spark):
    df = ranking.holm(ranking.benjamini_hochberg(family(spark, [0.01, 0.04, 0.03, 0.8]), "p", ["family"], ["k"]), "p", ["family"], ["k"])
    got = df.orderBy("k").collect()
    assert [r.q for r in got] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.8], abs=1e-14)
    assert [r.p_holm for r in got] == pytest.approx([0.04, 0.09, 0.09, 0.8], abs=1e-14)
    for ps, want in (([0.03, 0.001, 0.02], [0.04, 0.003, 0.04]), ([0.01, 0.04], [0.02, 0.04]), ([0.5, 0.5, 1], [1, 1, 1])):
        got = ranking.holm(family(spark, ps), "p", ["family"], ["k"]).orderBy("k").collect()
        assert [r.p_holm for r in got] == pytest.approx(want)


def test_tail_rule(spark):
    nulls = np.array([[0.5, 0.2, 0.1], [0.5 - 5e-13, 0.3, 0.0], [0.1, 0.1, 0.9]])
    observed = [0.5, 0.25, 0.1]
    df = spark.createDataFrame([(t, float(nulls[d, t]), observed[t]) for d in range(3) for t in range(3)], "t int, null double, obs double")
    got = df.groupBy("t", "obs").agg(ranking.tail_p(F.col("null"), F.col("obs")).alias("p"))
    assert [r.p for r in got.orderBy("t").collect()] == [0.75, 0.5, 0.75]


def test_wilson_bins_and_rounding(spark):
    df = metrics.wilson_table(spark.createDataFrame([(2, 4), (0, 0)], "k int, n int"), "k", "n").orderBy("n").collect()
    assert df[0].low is None and df[0].high is None
    assert (df[1].low, df[1].high) == pytest.approx((0.15003898915214947, 0.8499610108478506), abs=1e-15)
    p = spark.createDataFrame([(1, x) for x in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)], "y int, p double").withColumn("g", F.lit(1))
    assert [r.n for r in metrics.calibration_bins(p, "y", "p", ["g"], metrics.EDGES_DECIMAL).orderBy("bin").collect()] == [1, 1, 1, 1, 2]
    # 0.6 is below the third edge where edges are multiples of a fifth
    assert [r.n for r in metrics.calibration_bins(p, "y", "p", ["g"]).orderBy("bin").collect()] == [1, 1, 2, 0, 2]
    half = spark.createDataFrame([(1.2345,), (-1.2345,)], "x double").select(C.half_up(F.col("x")).cast("string").alias("s")).collect()
    assert [r.s for r in half] == ["1.235", "-1.235"]


def test_auc_ties_pairs_and_single_class(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 200), rng.integers(0, 12, 200) / 12
    df = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(y, p)] + [("b", 1, 0.5)], "g string, y int, p double")
    pairs = np.mean([(1.0 if a > b else 0.5 if a == b else 0.0) for a in p[y == 1] for b in p[y == 0]])
    out = {r.g: r for r in metrics.measures(df, "y", "p", ["g"]).collect()}
    assert out["a"].auc == pytest.approx(pairs, abs=1e-12) and linear.rank_auc(y, p) == pytest.approx(pairs, abs=1e-12)
    assert out["b"].auc is None and out["b"].status == "NOT_ESTIMABLE_SINGLE_CLASS" and out["b"].brier == 0.25
    assert ranking.roc_points(df.where("g = 'a'"), "y", "p", ["g"]).agg(F.sum("area")).first()[0] == pytest.approx(pairs, abs=1e-12)


def test_hc3_closed_form_influence_and_f(spark):
    rng = np.random.default_rng(1)
    y = np.r_[np.ones(11), np.zeros(17)]
    v = rng.normal(size=28) + y
    a = np.column_stack([np.ones(28), y])
    f = linear.hc3(a, v)
    want = np.sqrt(v[y == 0].var(ddof=1) / 16 + v[y == 1].var(ddof=1) / 10)
    assert f["se"][1] == pytest.approx(want, abs=1e-12)
    df = spark.createDataFrame([("g", int(b), float(c)) for b, c in zip(y, v)], "g string, y int, v double")
    r = metrics.two_group_hc3(df, "y", "v", ["g"]).first()
    assert (r.difference, r.se) == pytest.approx((f["beta"][1], want), abs=1e-12)
    one = linear.joint_f(a, v, [1])
    assert one["F"] == pytest.approx((f["beta"][1] / f["se"][1]) ** 2) and one["p"] == pytest.approx(f["p"][1], abs=1e-10)
    loo = linear.influence(a, v, 1.0)
    assert loo["loo_min"] <= f["beta"][1] <= loo["loo_max"] and loo["vif"] == pytest.approx([1.0])
    means = linear.adjusted_means(a, v, [1])["means"]
    assert [m[0] for m in means] == pytest.approx([v[y == 0].mean(), v[y == 1].mean()])
    with pytest.raises(ValueError):
        linear.hc3(np.column_stack([a, y]), v)


def test_distributions():
    assert D.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-12)
    assert D.t_quantile(0.975, 10) == pytest.approx(2.2281388519649, abs=1e-10)
    assert D.chi2_upper(3.0, 1) == pytest.approx(math.erfc(math.sqrt(1.5)), abs=1e-14)
    assert D.f_upper(3.0, 2, 20) == pytest.approx((1 + 6 / 20) ** -10, abs=1e-13)
    assert D.chi2_quantile(0.95, 1) == pytest.approx(3.841458820694, abs=1e-9)


def cohort(n=60, d=6, seed=20260910):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=n) > 0).astype(int)
    return x, y


def test_elastic_net_certificates_on_the_grid():
    x, y = cohort()
    for c in (0.01, 0.1, 1.0, 10.0):
        for l1 in (0.0, 0.25, 0.5, 1.0):
            f = elastic_net.fit(x, y, c, l1)
            assert f.kkt <= 1e-8 and -1e-12 <= f.gap <= 1e-10
            g = elastic_net.proximal(x, y, c, l1)
            assert np.abs(f.probabilities(x) - g.probabilities(x)).max() < 1e-5 and abs(f.objective - g.objective) < 1e-10
            again = elastic_net.fit(x, y, c, l1)
            assert np.array_equal(f.coef, again.coef) and f.intercept == again.intercept


def test_elastic_net_masks_and_separation():
    x, y = cohort()
    scanner = (np.arange(60) % 2).astype(float)
    z = np.column_stack([x, scanner])
    free = elastic_net.fit(z, y, 0.001, 1.0, np.array([True] * 6 + [False]))
    assert (free.coef[:6] == 0).all() and free.coef[6] != 0
    mask = np.array([True, True, False, True, True, True, False])
    for c in (0.001, 0.1, 3.0):
        for l1 in (0.0, 0.5, 1.0):
            f, g = elastic_net.fit(z, y, c, l1, mask), elastic_net.proximal(z, y, c, l1, mask)
            assert f.kkt <= 1e-8 and np.abs(f.probabilities(z) - g.probabilities(z)).max() < 1e-5 and abs(f.objective - g.objective) < 1e-10
    everything = elastic_net.fit(z, y, 0.3, 0.5, np.ones(7, bool))
    assert np.allclose(everything.coef, elastic_net.fit(z, y, 0.3, 0.5).coef, atol=1e-12)
    with pytest.raises(elastic_net.NotCertified):
        elastic_net.fit(np.column_stack([x, y]), y, 1.0, 0.5, np.array([True] * 6 + [False]))


def test_fold_preparation(spark):
    x = np.array([[1.0, 0, 5], [3, 1, 5], [np.nan, np.nan, 5], [7, np.nan, 5]])
    p = elastic_net.prepare(x, np.array([False, True, False]))
    assert p.fill.tolist() == [3, 0, 5] and p.mean[0] == 3.5 and p.keep.tolist() == [True, True, False]
    df = spark.createDataFrame([(0, 1.0, 5.0, "yes"), (0, 3.0, 5.0, "no"), (0, None, 5.0, None), (0, 7.0, 5.0, None)], "fold int, a double, b double, c string")
    state = {r.field: r for r in splits.fold_state(df, ["fold"], ["a", "b"]).collect()}
    assert (state["a"].fill, state["a"].mean, state["b"].dropped, state["b"].scale) == (3.0, 3.5, True, 1.0)
    assert splits.fold_mode(df, ["fold"], "c", ["no", "yes"]).first().fill == "no"


def test_tuning_ties(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.2), (0.1, 1.0, 0.2 + 5e-9), (0.1, 0.5, 0.2 + 9e-9), (0.01, 0.0, 0.2 + 2e-8)], "c double, l1 double, b double").withColumn("g", F.lit(1))
    r = ranking.tolerant_minimum(df, "b", ["g"], ["c", "l1"]).first()
    assert (r.c, r.l1) == (0.1, 0.5)


def test_regions_pooled_composite_and_states(spark):
    vox, tree = [], []
    for i in range(4):
        tree += [(2 * i, "L", f"n{i}", "c"), (2 * i + 1, "R", f"n{i}", "c")]
        vox += [("s", 2 * i, 2.0 * i + 1)] * 25 + [("s", 2 * i + 1, 2.0 * i + 4)] * 50
    v, h = spark.createDataFrame(vox, "s string, label int, pet double"), spark.createDataFrame(tree, "label int, side string, node string, composite string")
    nodes = {r.node: r for r in regional.node_stats(v, h, ["s"]).collect()}
    assert [nodes[f"n{i}"].pooled for i in range(4)] == [2 * i + 3 for i in range(4)]
    assert nodes["n0"].asymmetry == pytest.approx(-1.2) and nodes["n0"].status == "pass"
    assert regional.composites(regional.node_stats(v, h, ["s"]), ["s"]).first().value == 6.0
    short = regional.composites(regional.node_stats(v.where("label > 1"), h, ["s"]), ["s"]).first()
    assert short.value is None and short.status == "missing"
    cases = {9: (9, 0), 10: (10, 0), 24: (24, 0), 25: (25, 0), 40: (40, 3), 100: (100, 21), 200: (200, 0)}
    data = [(k, 1.0 if j >= zeros else 0.0) for k, (n, zeros) in cases.items() for j in range(n)]
    got = {r.label: r.status for r in regional.region_stats(spark.createDataFrame(data, "label int, pet double"), ["label"]).collect()}
    assert got == {9: "missing_label_below_hard_minimum", 10: "attention_low_label_voxels", 24: "attention_low_label_voxels", 25: "pass", 40: "attention_valid_pet_fraction", 100: "missing_insufficient_valid_pet_fraction", 200: "pass"}
    area = spark.createDataFrame([("s", 100.0, 2.0), ("s", 300.0, 4.0)], "s string, a double, t double")
    assert regional.weighted_mean(area, ["s"], "t", "a").first().weighted_mean == 3.5
    with pytest.raises(PySparkException):
        regional.weighted_mean(area.union(spark.createDataFrame([("s", 0.0, 1.0)], area.schema)), ["s"], "t", "a").collect()


def test_contracts_fail_loudly(spark):
    a = spark.createDataFrame([("k1", 1.0), ("k2", 0.5)], "id string, y double")
    with pytest.raises(PySparkException):
        a.select(C.strict_binary(F.col("y"), "y")).collect()
    with pytest.raises(PySparkException):
        assembly.align(a, spark.createDataFrame([("k1", 3)], "id string, z int"), "id", ["z"]).collect()
    with pytest.raises(ContractError):
        contracts.require(a, {"bad": F.col("y") == 0.5})
    with pytest.raises(ContractError):
        contracts.closed_columns(a, ["id"])
    bad = spark.createDataFrame([("a",), ("a",), (None,), ("x y",)], "k string")
    assert contracts.key_rules(bad, "k").first().asDict() == {"n_rows": 4, "null_keys": 1, "malformed_keys": 1, "repeated_keys": 1}
    assert [r.ok for r in spark.createDataFrame([("a/b.nii",), ("/a",), ("a/../b",), ("c:/x",), ("nul.txt",), ("a./b",)], "p string").select(C.safe_path(F.col("p")).alias("ok")).collect()] == [True, False, False, False, False, False]


def test_alignment_ignores_order_and_partitions(spark):
    left = spark.range(30).withColumnRenamed("id", "k")
    right = spark.range(40).select((39 - F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    want = rows(assembly.align(left, right, "k", ["v"]), "k")
    assert rows(assembly.align(left.repartition(7), right.repartition(5), "k", ["v"]), "k") == want and len(want) == 30


def test_descriptives(spark):
    df = spark.createDataFrame([(0.0, "A", 0), (1.0, "A", 0), (2.0, "B", 1), (3.0, "C", 1)], "v double, c string, y int")
    got = {(r.group_name, r.field, r.level, r.statistic): r.value for r in metrics.descriptives(df, "y", ["v"], ["c"]).collect()}
    assert got["all", "v", None, "q1"] == 0.75 and got["all", "c", "A", "count"] == 2 and got["all", "c", "A", "percent"] == 50
    assert got["responder", "c", "A", "count"] == 0 and got["all", "v", None, "sd"] == pytest.approx(np.std([0, 1, 2, 3], ddof=1))


def test_plans(spark):
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(60)], "row_pos long, y int")
    plan = splits.nested(splits.stratified(labels, "y", 5, 2, 1), "y", 3, 2)
    assert all(v == 0 for v in splits.plan_faults(plan).first())
    broken = plan.withColumn("role", F.when((F.col("role") == "validation") & (F.col("row_pos") == 3), "inner_train").otherwise(F.col("role")))
    assert splits.plan_faults(broken).first().not_once > 0
    assert rows(plan, *plan.columns) == rows(splits.nested(splits.stratified(labels.repartition(7), "y", 5, 2, 1), "y", 3, 2), *plan.columns)


def test_nested_predictions_ignore_held_out_labels(spark):
    from cohortloom.plans.prediction import Settings, results, run_nested

    x, y = cohort(48, 3)
    make = lambda yy: spark.createDataFrame([(k, int(v), *map(float, r)) for k, (r, v) in enumerate(zip(x, yy))], "row_pos long, y int, a double, b double, c double")
    small = Settings(c_grid=(0.1, 1.0), l1_grid=(0.0, 0.5))
    plan = splits.nested(splits.stratified(make(y), "y", 3, 1, 5), "y", 3, 6)
    first = results(run_nested(make(y), plan, {"m": ["a", "b", "c"]}, set(), small).cache())
    assert first.count() == 48 and first.agg(F.max("kkt")).first()[0] <= 1e-8
    fold0 = {r.row_pos for r in plan.where("fold = 0 and role = 'test'").collect()}
    flipped = [1 - v if k in fold0 else v for k, v in enumerate(y)]
    second = run_nested(make(flipped), plan, {"m": ["a", "b", "c"]}, set(), small)
    pick = lambda df: rows(df.where("fold = 0").select("row_pos", "p"), "row_pos")
    assert pick(first) == pick(second)


def test_resampling(spark):
    draws = resampling.numpy_draws(spark, 4, 10, 3)
    rng = np.random.default_rng(3)
    want = np.concatenate([rng.integers(0, 10, 10) for _ in range(4)])
    assert [r.row_pos for r in draws.orderBy("draw", "pos").collect()] == want.tolist()
    preds = spark.createDataFrame([(m, k, int(k > 7), 0.1 * k + 0.01 * m) for m in range(2) for k in range(10)], "model int, row_pos long, y int, p double")
    m = resampling.draw_metrics(draws, preds)
    one = [r for r in m.collect() if r.auc is None]
    table = resampling.model_intervals(m).collect()
    assert {r.valid_draws + r.skipped for r in table} == {4} and {r.skipped for r in table} == {len(one) // 2}
    again = rows(resampling.draw_metrics(draws.repartition(7), preds), "draw", "model")
    assert [(a, b, None if c is None else round(c, 9), round(e, 9)) for a, b, c, e in rows(m, "draw", "model")] == [(a, b, None if c is None else round(c, 9), round(e, 9)) for a, b, c, e in again]


def test_pattern_invariants(spark):
    rng = np.random.default_rng(2)
    raw = np.exp(rng.normal(size=(20, 12)))
    clr = np.log(raw) - np.log(raw).mean(axis=1, keepdims=True)
    scaled = raw * rng.uniform(1, 5, (20, 1))
    col = spark.createDataFrame([(list(map(float, r)),) for r in scaled], "v array<double>").select(C.centred_log(F.col("v")).alias("c")).collect()
    assert np.allclose([r.c for r in col], clr, atol=1e-12)
    with pytest.raises(PySparkException):
        spark.createDataFrame([([1.0, 0.0],)], "v array<double>").select(C.centred_log(F.col("v"))).collect()
    f = pattern.first_component(clr)
    boot = pattern.bootstrap_components(spark, clr, f["loading"], np.vstack([np.arange(20), np.zeros(20, int)])).orderBy("draw").collect()
    assert boot[0].cosine == pytest.approx(1) and boot[1].degenerate and boot[1].loading is None
    assert pattern.sign_by_anchor(np.array([-0.5, -0.1, 0.9]), ["l", "r", "z"], ("l", "r")) == (-1.0, "mean")
    assert pattern.sign_by_anchor(np.array([0.0, 0.0, -0.9]), ["l", "r", "z"], ("l", "r"))[0] == -1.0
    b = pattern.best_match(np.eye(3), np.eye(3)[[2, 0, 1]])
    assert b["matched"] == [1, 1, 1] and b["subspace"] == 1.0


def test_spatial_nulls(spark):
    rng = np.random.default_rng(4)
    w = rng.uniform(size=(10, 10))
    w = np.triu(w, 1) + np.triu(w, 1).T
    x = rng.normal(size=20)
    maps = pattern.hemisphere_nulls(x, w, pattern.random_signs(50, 9, 1))
    for half in (slice(0, 10), slice(10, 20)):
        assert np.allclose(maps[:, half].mean(axis=1), x[half].mean(), atol=1e-10)
        assert np.allclose((maps[:, half] ** 2).sum(axis=1), (x[half] ** 2).sum(), atol=1e-9)
        assert np.allclose(pattern.moran(maps[:, half], w), pattern.moran(x[half], w), atol=1e-9)
    assert np.allclose((maps[:, :10] * maps[:, 10:]).sum(axis=1), x[:10] @ x[10:], atol=1e-9)
    z = np.column_stack([np.ones(10), rng.normal(size=10)])
    e, cond = pattern.conditional_nulls(x[:10], z, w, pattern.random_signs(30, 8, 2))
    assert np.allclose(cond @ z, 0, atol=1e-8) and np.allclose((cond**2).sum(axis=1), e @ e, atol=1e-8)
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(10) for j in range(10) if i != j], "src int, dst int, w double")
    vals = spark.createDataFrame([("m", k, float(v)) for k, v in enumerate(x[:10])], "m string, pos int, value double")
    assert spatial.moran(vals, edges, ["m"]).first().moran == pytest.approx(pattern.moran(x[:10], w)[0])


def test_assignment_and_spins(spark):
    from itertools import permutations

    rng = np.random.default_rng(6)
    for _ in range(20):
        cost = rng.uniform(size=(6, 6))
        best = min(sum(cost[i, p[i]] for i in range(6)) for p in permutations(range(6)))
        got = pattern.assign(cost)
        assert sorted(got) == list(range(6)) and cost[np.arange(6), got].sum() == pytest.approx(best)
    v = rng.normal(size=(16, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = pattern.spins(spark, np.vstack([v, v * [-1, 1, 1]]), 12, 9)
    for r in s.collect():
        assert sorted(r.perm[:16]) == list(range(16)) and sorted(r.perm[16:]) == list(range(16, 32))
    turns = pattern.random_rotations(5, 1)
    assert np.allclose(turns.transpose(0, 2, 1) @ turns, np.eye(3)) and np.allclose(np.linalg.det(turns), 1)


def test_calibration_states_and_profile():
    rng = np.random.default_rng(8)
    z = rng.normal(size=400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(0.3 + 0.7 * z)))).astype(int)
    c = linear.calibrate(y, 1 / (1 + np.exp(-z)))
    assert c["status"] == "ESTIMABLE" and 0.3 < c["slope"] < 1.2
    assert linear.calibrate(np.ones(5), np.full(5, 0.5))["status"] == "NOT_ESTIMABLE_SINGLE_CLASS"
    assert linear.calibrate(y, np.full(400, 0.5))["status"].startswith("CONSTANT")
    x = np.column_stack([np.ones(400), z])
    r = linear.profile_interval(x, y, 1)
    assert r["lo"] < r["log_or"] < r["hi"] and r["status"] == "estimated"
    assert linear.profile_interval(x, (z > 0).astype(int), 1)["status"] == "nonestimable_separation"
