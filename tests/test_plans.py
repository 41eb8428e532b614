import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortloom.operators import imaging
from cohortloom.operators.contracts import ContractError
from cohortloom.plans import families, protocol
from cohortloom.plans.prediction import Settings
from cohortloom.sources import synthetic

CLINICAL = ["z_age", "male", "z_duration", "z_log_frequency", "lesional"]


@pytest.fixture(scope="module")
def study(spark):
    people = synthetic.cohort(spark, 72, seed=2374)
    types = people.withColumns({"type_focal": (F.col("row_pos") % 3 == 1).cast("double"), "type_combined": (F.col("row_pos") % 3 == 2).cast("double"), "eti_structural": (F.col("row_pos") % 5 == 1).cast("double"), "eti_other": (F.col("row_pos") % 5 == 3).cast("double")})
    cohort = families.design_table(types, ["age", "duration", "log_frequency"], [f"t1_{k}" for k in range(6)]).cache()
    long = people.select("study_id", F.explode(F.array(*[F.lit(v) for v in families.VARIANTS])).alias("variant"), F.posexplode(F.array(*[F.col(f"pet_{k}") for k in range(6)])).alias("k", "value"))
    long = long.select("study_id", "variant", F.concat(F.lit("r"), "k").alias("region"), (F.col("value") + 0.01 * F.crc32(F.concat("study_id", "variant").cast("binary")) / 2**32).alias("value")).cache()
    return cohort, long, {f"r{k}": f"z_t1_{k}" for k in range(6)}


def test_families_are_complete_and_corrected(study):
    cohort, long, matched = study
    twelve = families.morphometric_family(long, cohort, matched, CLINICAL, "scanner").collect()
    assert len(twelve) == 12 and {r.family_tests for r in twelve} == {12}
    p = np.sort([r.p for r in twelve])
    want = np.minimum.accumulate((p * 12 / np.arange(1, 13))[::-1])[::-1].clip(max=1)
    assert np.allclose(np.sort([r.q_family for r in twelve]), want, atol=1e-14)
    extended = families.extended_family(long, cohort, ["type_focal", "type_combined"], ["eti_structural", "eti_other"], CLINICAL, "scanner").cache()
    processing = families.processing_family(long, cohort, matched, CLINICAL, "scanner", with_influence=False).cache()
    assert (extended.count(), processing.count()) == (18, 96)
    joint = families.followup_families(extended, processing)
    assert joint.count() == 114 and joint.where("q_all114 is null or q_family is null").count() == 0
    with pytest.raises(ContractError):
        families.processing_family(long.where("variant <> 'PVC6'"), cohort, matched, CLINICAL, "scanner")
    with pytest.raises(ContractError):
        families.corrected(extended.limit(17), 18)


def test_factor_and_comparison_lists(study):
    cohort, _, _ = study
    r = families.factor_test(cohort.withColumn("g", F.lit(1)), ["g"], "pet_0", ["z_age", "male"], ["type_focal", "type_combined"]).first()
    assert 0 <= r.p <= 1 and len(r.means) == 3 and len(r.differences) == 3
    pairs = families.processing_comparisons()
    assert len(pairs) == len(set(pairs)) == 28 and len(families.processing_models({"CP": [], "CPT": []})) == 14


def test_protocol_and_tampering(spark, tmp_path):
    people = synthetic.cohort(spark, 60, seed=5)
    settings = Settings(c_grid=(0.1, 1.0), l1_grid=(0.0, 1.0), repeats=2)
    folder = f"file://{tmp_path}/run"
    protocol.prepare(people, folder, settings, 3)
    sets = {"C": ["age", "male", "scanner"], "CP": ["age", "male", "pet_0", "scanner"]}
    for m, c in sets.items():
        protocol.fit_model(spark, folder, m, c, {"male", "scanner"}, settings, {"scanner"})
    tables = protocol.summarize(spark, folder, list(sets), settings, draws=20)
    assert tables["performance"].count() == 2 and tables["comparisons"].count() == 2
    shown = {(r.base, r.metric): r for r in protocol.comparison_display(tables["comparisons"]).collect()}
    raw = {(r.base, r.metric): r for r in tables["comparisons"].collect()}
    assert shown["C", "brier"].lo == -raw["C", "brier"].hi and shown["C", "auc"].lo == raw["C", "auc"].lo
    assert tables["numerics"].agg(F.max("max_kkt")).first()[0] <= 1e-8
    with pytest.raises(ContractError):
        protocol.verified(spark, folder, Settings(c_grid=(0.1,), l1_grid=(0.0, 1.0), repeats=2))
    people.limit(59).write.mode("overwrite").parquet(f"{folder}/cohort")
    with pytest.raises(ContractError):
        protocol.verified(spark, folder, settings)
    with pytest.raises(PySparkException):
        protocol.prepare(people, folder, settings, 3)


def test_imaging(spark):
    eye, two = np.eye(4), np.diag([2.0, 2, 2, 1])
    imaging.same_grid(two, two + 1e-6)
    with pytest.raises(ValueError):
        imaging.same_grid(eye, eye)
    assert imaging.header_geometry(two, eye, eye, (1, eye), (0, np.linalg.inv(two)), (0, eye))["voxel_error"] < 1e-12
    with pytest.raises(ValueError):
        imaging.header_geometry(two, eye, eye, (1, eye), (0, eye), (0, eye))
    x = np.random.default_rng(0).normal(size=(20, 3))
    b = np.array([1.0, 2, 3])
    assert imaging.normal_equations(x.T @ x, x.T @ x @ b, b)["difference"] < 1e-10
    s = spark.createDataFrame([("s1", 1, 0.5), ("s1", 2, 0.7)], "subject string, label int, mean double")
    pairs = spark.createDataFrame([("b", "L", 2), ("a", "L", 1)], "name string, side string, label int")
    assert imaging.panel(s, pairs, ["subject"]).first().regions == [0.5, 0.7]
    subjects = spark.createDataFrame([("s1", "p.nii", "t.nii", "m.nii", "x.lta")], "subject string, pet string, t1 string, brainmask string, transform string")
    plan = imaging.grid_step(subjects)
    assert plan.count() == 3 and "--dof" in plan.where("step = 'register'").first().argv
    with pytest.raises(PySparkException):
        imaging.grid_step(subjects.withColumn("pet", F.lit("--evil"))).collect()
    v = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 1), (1, 0, 2, 2)], "i int, j int, k int, label int")
    g = spark.createDataFrame([(1, "a"), (2, "b")], "label int, group string")
    assert {r.group: r.voxels for r in imaging.overlay_counts(v, g, "i", 0).collect()} == {"a": 2, "b": 0}
    assert imaging.bounding_boxes(v).where("label = 1").first().j_max == 1
    with pytest.raises(PySparkException):
        spark.createDataFrame([(1.5,)], "l double").select(imaging.integer_labels(F.col("l"))).collect()


def test_external_cohort(spark):
    from cohortloom.plans import spatial

    rng = np.random.default_rng(11)
    n, regions = 8, [f"r{k}" for k in range(20)]
    raw = np.exp(rng.normal(size=(30, 20)) * 0.1 + np.outer(rng.normal(size=30), np.linspace(-1, 1, 20)))
    v = rng.normal(size=(n, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    coords = np.vstack([v, v * [-1, 1, 1]])
    targets, names = rng.normal(size=(2 * n, 3)), ["a", "b", "c"]
    out = spatial.external_cohort(spark, raw, regions, ("r3", "r4"), list(range(2 * n)), targets, names, coords, rng.normal(size=(2 * n, 2)), boots=20, nulls=30)
    load = {r.region: r.loading for r in out["pattern"].collect()}
    assert load["r3"] + load["r4"] > 0 and out["bootstrap"].where("degenerate").count() == 0
    for name in ("spectral", "conditional"):
        rows = out[name].collect()
        assert len(rows) == 3 and all(1 / 31 - 1e-12 <= r.p <= r.q + 1e-12 <= 1 + 1e-9 for r in rows)
    spun = {r.target: r for r in out["spins"].collect()}
    from cohortloom.operators.linear import ranks

    x = np.array([load[r] for r in regions[: 2 * n]])
    for k, name in enumerate(names):
        assert spun[name].rho == pytest.approx(np.corrcoef(ranks(x), ranks(targets[:, k]))[0, 1])
    assert out["intervals"].count() == 3
    with pytest.raises(ContractError):
        spatial.spatial_family(out["bootstrap"].select("draw"), spark.createDataFrame([("a", 0.1)], "target string, observed double"), 18)


def test_spin_tail(spark):
    from cohortloom.plans import spatial

    perms = [list(range(6)), list(range(5, -1, -1)), [5, 0, 1, 2, 3, 4]]
    spins = spark.createDataFrame(list(enumerate(perms)), "draw long, perm array<int>")
    x = np.arange(6.0)
    r = spatial.spin_statistics(spark, x, x[:, None], ["t"], spins).first()
    assert r.rho == pytest.approx(1) and r.p == 0.75


def test_graph_rules():
    from cohortloom.plans import spatial

    c = np.array([[0.0, 0, 0], [1, 0, 0], [2.1, 0, 0], [9, 0, 0]])
    a, b = spatial.graph_weights(c, 1), spatial.graph_weights(c, 1, from_first=True)
    assert (a == b).all() and (a == a.T).all() and a[3, 2] == 1
    with pytest.raises(ValueError):
        spatial.graph_weights(np.zeros((3, 3)), 1)
    assert spatial.graph_weights(np.zeros((3, 3)), 1, from_first=True).sum() > 0


def test_influence_has_a_row_for_every_source(spark, monkeypatch):
    """Three cells of (y, english) are of full rank; what can't be fitted has a status, not a gap."""
    from cohortloom.plans import catalogue

    rng = np.random.default_rng(8)
    cells = {"four": [(0, 0), (0, 1), (1, 0), (1, 1)], "three": [(0, 0), (1, 0), (1, 1)], "one class": [(1, 0), (1, 1)], "tied": [(0, 0), (1, 1)]}
    rows = [(s, float(y), float(e), float(rng.normal()), float(rng.normal())) for s, c in cells.items() for y, e in c * 5] + [("few", 1.0, 0.0, 1.0, 2.0), ("few", 0.0, 1.0, 2.0, 1.0)]
    made = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row_pos long, source string, y double, english double, log_chars double, x2 double")
    monkeypatch.setattr(catalogue, "design", lambda spark, d: made)
    got = {(r.source, r.region): r for r in catalogue.q_influence(spark, "").collect()}
    assert set(got) == {(s, c) for s in [*cells, "few"] for c in ("log_chars", "x2")}
    for (s, _), r in got.items():
        assert (r.status == "ok") == (s in ("four", "three")) == (r.estimate is not None and r.loo_min is not None)
        assert r.status == "ok" or r.status.startswith("not estimable: ") and r.se is None and r.sign_changes is None
    assert got["few", "x2"].n == 2 and got["three", "x2"].n == 15


def test_settings_of_documents_and_time_limits():
    from cohortloom.operators.contracts import ContractError
    from cohortloom.plans.prediction import Settings

    model = {"clinical": ["age", "sex"], "categories": {"sex": ["f", "m"]}, "c_grid": [0.1, 1.0], "l1_grid": [0.0], "seed": 5, "repeats": 2, "inner_folds": 3, "thresholds": [0.5], "max_missing": 0.2, "seconds": 60.0}
    made, regions = Settings.from_documents(model, {"regions": ["a", "b"]})
    assert made.c_grid == (0.1, 1.0) and made.categories == {"sex": ("f", "m")} and made.seconds == 60 and regions == ["a", "b"]
    for change in ({"seed": True}, {"seed": 0}, {"c_grid": [1.0, 0.1]}, {"c_grid": [float("nan")]}, {"categories": {"x": ["a"]}}, {"extra": 1}, {"max_missing": 0}):
        with pytest.raises(ContractError):
            Settings.from_documents(model | change, {"regions": ["a"]})
    with pytest.raises(ContractError):
        Settings.from_documents(model, {"regions": ["a", "a"]})
    for seconds in (0, -1, float("inf"), float("nan"), "60"):
        with pytest.raises(ContractError):
            Settings(seconds=seconds)


def test_a_task_over_its_time_is_kept_as_a_failure(spark):
    from cohortloom.operators import splits
    from cohortloom.plans.prediction import Settings, run_nested

    rng = np.random.default_rng(3)
    cohort = spark.createDataFrame([(k, k % 2, float(v)) for k, v in enumerate(rng.normal(size=40))], "row_pos long, y int, x double")
    plan = splits.nested(splits.stratified(cohort, "y", 2, 1, 1), "y", 2, 2)
    got = run_nested(cohort, plan, {"m": ["x"]}, set(), Settings(seconds=1e-9))
    assert {r.status for r in got.collect()} == {"TimeoutError: the time for a task is over"}


def test_family_dispatcher(spark):
    from cohortloom.operators.contracts import ContractError
    from cohortloom.plans import families

    df = spark.range(1)
    for name, arguments in (("unknown", {}), ("extended", {"wrong": 1})):
        with pytest.raises(ContractError):
            families.run_family(name, df, df, **arguments)


def test_joint_inner_folds_need_three_a_cell(spark):
    from pyspark.errors import PySparkException

    from cohortloom.operators import splits

    rows = spark.createDataFrame([(k, k % 2, int(k < 4)) for k in range(60)], "row_pos long, y int, scanner int")
    outer = splits.stratified(rows, "y", 3, 1, 1)
    with pytest.raises(PySparkException):
        splits.joint_inner(outer, rows, "y", 3, 2).collect()
    even = rows.withColumn("scanner", (rows.row_pos / 2).cast("int") % 2)
    plan = splits.joint_inner(outer, even, "y", 3, 2)
    faults = splits.plan_faults(plan).first()
    assert not any(faults)
    cells = {tuple(r)[:-1]: r["count"] for r in plan.where("role = 'validation'").join(even.select("row_pos", "scanner"), "row_pos").groupBy("fold", "inner_fold", "scanner", "y").count().collect()}
    assert len(cells) == 36 and min(cells.values()) >= 3


def test_bridge_against_plain_loops(spark):
    from cohortloom.operators import linear
    from cohortloom.plans import bridge

    rng = np.random.default_rng(5)
    clr, y = rng.normal(size=(30, 6)), (np.arange(30) % 2)
    rows = rng.integers(0, 30, (4, 30))
    rows[3] = np.where(y[rows[3]] == 1, rows[3], rows[3] // 2 * 2 + 1)  # one class: no response fit
    kinds = np.arange(30) % 3
    types = np.column_stack([kinds == 1, kinds == 2]).astype(float)
    loading = rng.normal(size=6)
    s = bridge.repeated_scores(clr, rows[0], loading, 2.0)
    assert np.allclose(s, (clr[rows[0]] - clr[rows[0]].mean(axis=0)) @ loading / 2) and len(set(s)) == len(set(rows[0]))
    draws = spark.createDataFrame([(k, r.tolist(), loading.tolist()) for k, r in enumerate(rows)], "draw long, rows array<int>, loading array<double>")
    got = bridge.bridge_draws(draws, clr, y, types, clr[:, :2], 2.0)
    table = {(r.draw, r.quantity): r for r in got.collect()}
    a = np.column_stack([np.ones(30), types[rows[0]]])
    b = np.linalg.lstsq(a, s, rcond=None)[0]
    assert abs(table[0, "type_1"].value - b[1]) < 1e-10 and abs(table[0, "type_difference"].value - (b[1] - b[2])) < 1e-10
    assert abs(table[0, "region_1"].value - np.corrcoef(linear.ranks(s), linear.ranks(clr[rows[0], 1]))[0, 1]) < 1e-10
    assert table[3, "response"].value is None and bridge.failures(got).count() == 1
    scopes = {r.quantity: r.scope for r in bridge.bridge_intervals(got, 4).collect()}
    assert scopes["response"].startswith("diagnostic") and scopes["type_1"].startswith("percentile over people")
    p = spark.createDataFrame([("type", 0.03), ("response", 0.02)], "test string, p double")
    assert {r.test: round(r.p_holm, 9) for r in bridge.primary_tests(p).collect()} == {"type": 0.04, "response": 0.04}


def test_display_joins_fail_loudly(spark):
    from pyspark.errors import PySparkException

    from cohortloom.operators import display

    left = spark.createDataFrame([(1, 0.5), (2, 0.6)], "k long, v double")
    same = left.withColumnRenamed("v", "w")
    assert display.matched_once(left, same, ["k"], ["w"]).count() == 2
    for right in (same.limit(1), same.union(same.limit(1)), same.union(spark.createDataFrame([(3, 0.1)], "k long, w double"))):
        with pytest.raises(PySparkException):
            display.matched_once(left, right, ["k"], ["w"]).collect()
    with pytest.raises(PySparkException):
        display.same_version(left, left.withColumn("v", left.v + 1e-9), ["k"], ["v"]).collect()
    with pytest.raises(PySparkException):
        display.with_interval(spark.createDataFrame([(0.5, 0.6, 0.7)], "v double, lo double, hi double"), "v", "lo", "hi").collect()
    with pytest.raises(PySparkException):
        display.display_bins(spark.createDataFrame([(1, 0.1), (0, 0.3)], "y int, p double"), "y", "p", []).collect()
