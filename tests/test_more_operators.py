"""Rules of smaller operators that no query shows."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortloom.functions import columns as C
from cohortloom.operators import assembly, contracts, linear, metrics, pattern, ranking, regional, resampling, spatial, splits


def test_dummies_refuse_unknown_levels(spark):
    df = spark.createDataFrame([("female",), ("male",)], "sex string")
    assert [r[0] for r in df.select(*assembly.reference_dummies({"sex": ["female", "male"]})).collect()] == [0.0, 1.0]
    for v in ("other", None):
        with pytest.raises(PySparkException):
            df.union(spark.createDataFrame([(v,)], "sex string")).select(*assembly.reference_dummies({"sex": ["female", "male"]})).collect()


def test_supplied_log_must_agree(spark):
    make = lambda rows: spark.createDataFrame(rows, "f double, l double").select(assembly.log_frequency("f", "l").alias("v")).collect()
    assert make([(3.0, float(np.log(4.0))), (None, None)])[1].v is None
    for bad in ([(3.0, 1.0)], [(None, 1.0)], [(3.0, None)]):
        with pytest.raises(PySparkException):
            make(bad)


def test_gather_and_swap(spark):
    v = spark.createDataFrame([(k, float(k * k)) for k in range(5)], "pos int, value double")
    walk = spark.createDataFrame([(0, 4), (1, 2)], "to_pos int, pos int")
    assert [(r.to_pos, r.value) for r in assembly.gather(v, walk, "pos").orderBy("to_pos").collect()] == [(0, 16.0), (1, 4.0)]
    with pytest.raises(PySparkException):
        assembly.gather(v, walk.union(spark.createDataFrame([(2, 9)], walk.schema)), "pos").collect()
    base = spark.createDataFrame([(1, 1.0, "a")], "id int, pet double, o string")
    got = assembly.swap_columns(base, spark.createDataFrame([(1, 5.0)], "id int, pet double"), "id", ["pet"])
    assert got.columns == base.columns and got.first().pet == 5.0


def test_reference_gate_and_zero_rule(spark):
    v = spark.createDataFrame([("s", 1, x, 1.0) for x in (0.0, 2.0, 4.0)] + [("s", 2, 9.0, 0.0)], "subject string, label int, pet double, brainmask double")
    ref = regional.reference_means(v, {"all": F.lit(True)}, ["subject"])
    r = ref.first()
    assert r.all_mean == 2.0 and r.all_count == 3 and r.positive_share == pytest.approx(2 / 3)
    assert regional.reference_gate(ref, {"all": 3}).first().passed is False
    assert regional.region_stats(v.where("label = 1"), ["label"]).first().valid_voxels == 2
    for bad in (-1.0, float("nan"), float("inf"), None):
        with pytest.raises(PySparkException):
            regional.reference_means(v.union(spark.createDataFrame([("s", 1, bad, 1.0)], v.schema)), {"all": F.lit(True)}, ["subject"]).collect()


def test_face_majority(spark):
    f = spark.createDataFrame([(1, 1, 1, 2), (2, 1, 2, 2), (3, 2, 1, 2), (4, 1, 2, 3)], "face int, v1 int, v2 int, v3 int")
    assert [r.label for r in regional.face_labels(f).orderBy("face").collect()] == [1, 2, 2, 1]


def test_predictions_and_parcels(spark):
    ids = spark.createDataFrame([(0,), (1,)], "row_pos int")
    cells = [("m", r, k, 0.5) for r in range(2) for k in range(2)]
    make = lambda rows: contracts.predictions_rules(spark.createDataFrame(rows, "model string, repeat int, row_pos int, p double"), ids, 2).first().complete
    assert make(cells) and not make(cells[:-1]) and not make([*cells[:-1], ("m", 1, 1, 1.5)]) and not make([*cells[:-1], cells[0]])
    atlas = [(k, "R" if k < 34 else "L", (k + 34) % 68) for k in range(68)]
    rules = lambda rows: contracts.parcel_rules(spark.createDataFrame(rows, "parcel_pos int, hemi string, homologue_pos int")).first()
    ok = rules(atlas)
    assert (ok.n, ok.n_right, ok.bad_homologues, ok.out_of_order) == (68, 34, 0, 0)
    assert rules([(0, "R", 1), *atlas[1:]]).bad_homologues > 0


def test_fold_count_rule(spark):
    for ones, want in ((8, 3), (10, 5), (9, 4), (7, 3), (5, None)):
        df = spark.createDataFrame([(1,)] * ones + [(0,)] * 30, "y int")
        got = splits.fold_count(df, "y").first().folds
        fits = [k for k in (5, 4, 3) if ones // k >= 2 and ones - -(-ones // k) >= 3]
        assert got == (fits[0] if fits else None)


def test_grouped_folds_keep_people_together(spark):
    df = spark.createDataFrame([(k // 3, k % 2) for k in range(60)], "person int, y int")
    got = splits.grouped(df, "person", "y", 3)
    assert got.count() == 20 and got.groupBy("person").count().where("count > 1").count() == 0


def test_optimism_signs(spark):
    df = spark.createDataFrame([(0.8, 0.7, 0.15, 0.2)], "bag_auc double, original_auc double, bag_brier double, original_brier double")
    r = resampling.optimism(df, 0.75, 0.18).first()
    assert (r.corrected_auc, r.corrected_brier) == pytest.approx((0.65, 0.23))


def test_difference_signs(spark):
    m = spark.createDataFrame([(0, "a", 0.6, 0.2), (0, "b", 0.7, 0.15), (1, "a", None, 0.1), (1, "b", None, 0.1)], "draw int, model string, auc double, brier double")
    pairs = spark.createDataFrame([("a", "b")], "base string, added string")
    r = resampling.paired_differences(m, pairs).collect()
    assert len(r) == 1 and (r[0].auc, r[0].brier) == pytest.approx((0.1, 0.05))
    assert resampling.paired_differences(m, pairs, brier_sign=1).first().brier == pytest.approx(-0.05)


def test_moments_and_columns(spark):
    x = [1.0, 2.0, 4.0, 8.0, 16.0, 3.0, 3.0]
    r = spark.createDataFrame([(v,) for v in x], "x double").agg(C.unbiased_skew(F.col("x")).alias("s"), C.unbiased_kurtosis(F.col("x")).alias("k")).first()
    assert (r.s, r.k) == pytest.approx((1.8215, 3.2448), abs=1e-4)
    z = spark.createDataFrame([(800.0,), (-800.0,), (0.0,)], "z double").select(C.softplus(F.col("z")).alias("s"), C.expit(F.col("z")).alias("e")).collect()
    assert [q.s for q in z] == pytest.approx([800.0, 0.0, np.log(2)]) and [q.e for q in z] == pytest.approx([1, 0, 0.5])
    u = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(C.unit(F.col("v")).alias("u")).collect()
    assert u[0].u == pytest.approx([0.6, 0.8]) and u[1].u is None


def test_largest_absolute_and_ranks(spark):
    df = spark.createDataFrame([("g", "b", -3.0), ("g", "a", 3.0), ("g", "c", 1.0)], "g string, name string, v double")
    assert ranking.largest_absolute(df, "v", ["g"], "name").first().name == "a"
    assert linear.ranks(np.array([3.0, 1, 3, 2])).tolist() == [3.5, 1, 3.5, 2]


def test_map_correlations_without_spread(spark):
    maps = spark.createDataFrame([(0, k, 1.0) for k in range(4)] + [(1, k, float(k)) for k in range(4)], "draw int, pos int, value double")
    t = spark.createDataFrame([("t", k, float(-k)) for k in range(4)], "target string, pos int, t double")
    got = {r.draw: r.r for r in spatial.map_correlations(maps, t).collect()}
    assert got[0] is None and got[1] == pytest.approx(-1.0)


def test_twin_points_fail(spark):
    p = spark.createDataFrame([("R", 0, 0.0, 0.0, 0.0), ("R", 1, 0.0, 0.0, 0.0)], "hemi string, pos int, x double, y double, z double")
    with pytest.raises(PySparkException):
        spatial.distinct_points(p, ["hemi"]).collect()


def test_stratified_draws_stay_in_strata():
    s = np.array([0, 1, 0, 1, 1, 0])
    ix = pattern.stratified_indices(s, 20, 1)
    assert (s[ix] == s).all()


def test_distribution_counts_what_is_not_finite(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, -1.0, float("nan"), float("inf"), None)], "g string, x double")
    r = metrics.distribution(df, "x", ["g"]).first()
    assert (r.n_finite, r.n_other, r.min, r.max, r.positive) == (2, 3, -1.0, 1.0, 0.5)


def test_gaps_in_a_family_fail(spark):
    df = spark.createDataFrame([("f", 1, 0.1), ("f", 2, None)], "f string, k int, p double")
    for adjust in (ranking.benjamini_hochberg, ranking.holm):
        with pytest.raises(PySparkException):
            adjust(df, "p", ["f"], ["k"]).collect()
    assert df.select(C.logit(F.col("p")).alias("z")).where("z is null").count() == 1


def test_an_extreme_value_leaves_no_bucket_with_most_rows(spark):
    from pyspark.sql import functions as F

    from cohortloom.operators import ranking

    rng = np.random.default_rng(8)
    x = np.concatenate((rng.lognormal(5, 1, 5000), [1e12], -rng.lognormal(2, 1, 500), [0.0, 0.0]))
    near = np.concatenate((1 + 1e-6 * rng.random(5000),))
    rows = [("a", float(v)) for v in x] + [("b", float(v)) for v in near]
    df = spark.createDataFrame(rows, "g string, x double")
    placed = ranking._bucketed(df, ["g"], "x")
    share = placed.groupBy("g", "_bucket").count().groupBy("g").agg(F.max("count").alias("m"), F.count(F.lit(1)).alias("k")).collect()
    assert all(r.m <= 0.03 * 5000 and r.k < 6000 for r in share)
    for g, values in (("a", x), ("b", near)):
        got = sorted((r.x, r["rank"]) for r in ranking.average_ranks(df, "x", ["g"]).where(F.col("g") == g).collect())
        order = np.sort(values)
        want = [(np.searchsorted(order, v) + np.searchsorted(order, v, "right") + 1) / 2 for v in order]
        assert [r for _, r in got] == want
        pairs = placed.where(F.col("g") == g).orderBy("x").select("_bucket").collect()
        assert all(a[0] <= b[0] for a, b in zip(pairs, pairs[1:]))


def test_component_of_moments_is_that_of_the_rows(spark):
    from cohortloom.operators import pattern

    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 6)) * [3, 1, 1, 2, 1, 1]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "z array<double>").repartition(5)
    a, b = pattern.component_of_moments(*pattern.moments(df, "z")), pattern.first_component(x)
    assert abs(abs(a["loading"] @ b["loading"]) - 1) < 1e-12 and abs(a["eigen1"] - b["eigen1"]) < 1e-9 and abs(a["explained"] - b["explained"]) < 1e-12
