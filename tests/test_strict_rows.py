"""Stratified draws against repeated rows, and tables that fail instead of leaving something out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import imaging, pattern, regional, spatial, weights
from cohortloom.operators.contracts import ContractError
from cohortloom.plans import protocol
from cohortloom.sources import tables


def test_stratified_draws_equal_repeated_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 5)) * [3, 1, 1, 1, 1]
    side = np.array(["b" if k % 3 else "a" for k in range(40)])
    df = spark.createDataFrame([(k, x[k].tolist(), side[k]) for k in range(40)], "row_pos long, z array<double>, scanner string").repartition(3)
    f = pattern.first_component(x)["loading"]
    got = {r.draw: r for r in weights.stratified_component_draws(df, "scanner", f, 20, 9, 8).collect()}
    assert sorted(got) == list(range(20))
    for d, r in got.items():
        parts = []
        for k, s in enumerate("ab"):
            at = np.flatnonzero(side == s)
            w = np.concatenate([weights.block_weights(b, len(at), 20, 9 + k, 8)[d] for b in range(-(-len(at) // 8))])
            assert w.sum() == len(at)
            parts.append(np.repeat(x[at], w, axis=0))
        want = pattern.first_component(np.concatenate(parts))
        assert np.allclose(r.loading, want["loading"] * np.sign(want["loading"] @ f), atol=1e-8) and r.eigen1 == pytest.approx(want["eigen1"])
    with pytest.raises(ContractError, match="reference"):
        weights.stratified_component_draws(df, "scanner", np.eye(5)[2], 2, 9)
    with pytest.raises(ContractError, match="without one"):
        weights.stratified_component_draws(df.withColumn("scanner", F.when(F.col("row_pos") > 0, F.col("scanner"))), "scanner", f, 2, 9)


def test_a_draw_without_a_component_fails_the_whole(spark):
    df = spark.createDataFrame([(k, [float(k == 0), 0.0, 0.0], "a") for k in range(4)], "row_pos long, z array<double>, scanner string")
    with pytest.raises(ContractError, match="draws have no component"):
        weights.stratified_component_draws(df, "scanner", np.array([1.0, 0.0, 0.0]), 60, 3)


def test_strict_correlations(spark):
    maps = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate([1, 2, 4])] + [(1, k, 5.0) for k in range(3)], "draw long, pos long, value double")
    targets = spark.createDataFrame([("t", k, float(v)) for k, v in enumerate([3, 1, 2])], "target string, pos long, t double")
    assert {r.draw: r.r is None for r in spatial.map_correlations(maps, targets).collect()} == {0: False, 1: True}
    assert spatial.map_correlations(maps.where("draw = 0"), targets, strict=True).first().r == pytest.approx(np.corrcoef([1, 2, 4], [3, 1, 2])[0, 1])
    with pytest.raises(Exception, match="no spread"):
        spatial.map_correlations(maps, targets, strict=True).collect()
    with pytest.raises(Exception, match="no spread"):
        spatial.map_correlations(maps.where("draw = 0").withColumn("value", F.when(F.col("pos") > 0, F.col("value"))), targets, strict=True).collect()


def test_parcels_and_overlays_are_complete(spark):
    faces = spark.createDataFrame([("L", 1, 2, 2), ("L", 1, 2, 3), ("L", 7, 8, 9), ("R", 1, 1, 2), ("R", 2, 3, 2)], "hemisphere string, v1 int, v2 int, v3 int")
    values = spark.createDataFrame([(h, k, k / 2) for h in "LR" for k in (1, 2)], "hemisphere string, label int, value double")
    got = {(r.hemisphere, r.label): r.faces for r in regional.parcel_faces(faces, values, 2).collect()}
    assert got == {("L", 1): 1, ("L", 2): 1, ("R", 1): 1, ("R", 2): 1}
    with pytest.raises(Exception, match="34 labels"):
        regional.parcel_faces(faces, values).collect()
    with pytest.raises(Exception, match="no faces"):
        regional.parcel_faces(faces.where("hemisphere = 'L'"), values, 2).collect()
    voxels = spark.createDataFrame([(7, 0, 0, 1), (7, 1, 0, 2), (8, 0, 0, 3)], "i int, j int, k int, label int")
    groups = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "label int, group string")
    assert {r.group: r.voxels for r in imaging.overlay_counts(voxels, groups, "i", 7).collect()} == {"x": 2, "y": 0}
    assert imaging.overlay_counts(voxels, groups.where("group = 'x'"), "i", 7, complete=True).first().voxels == 2
    with pytest.raises(Exception, match="isn't on the plane"):
        imaging.overlay_counts(voxels, groups, "i", 7, complete=True).collect()


def test_first_table(spark):
    cohort = spark.createDataFrame([("a", 1, float(np.log1p(4))), ("b", 0, 0.0)], "study_id string, y int, log1p_baseline_monthly_frequency double")
    rows = [("a", "focal", "tumour", "s1"), ("b", "both", "NA", "s2"), ("c", "", "x", "s1")]
    meta = spark.createDataFrame(rows, "study_id string, epilepsy_type string, etiology_detailed string, scanner_source_key string")
    got = {r.study_id: r for r in tables.first_table(cohort, meta).collect()}
    assert set(got) == {"a", "b"} and got["b"].etiology_group == "NA" and got["a"].scanner == "s1"
    assert got["a"].baseline_monthly_frequency_reconstructed == pytest.approx(4) and got["b"].baseline_monthly_frequency_reconstructed == 0
    with pytest.raises(ContractError, match="one row"):
        tables.first_table(cohort, meta.union(meta.where("study_id = 'c'")))
    with pytest.raises(Exception, match="no metadata"):
        tables.first_table(cohort, meta.where("study_id = 'a'")).collect()
    with pytest.raises(Exception, match="no value"):
        tables.first_table(cohort.union(cohort.limit(1).withColumn("study_id", F.lit("c"))), meta).collect()


def test_four_models_and_three_have_the_same_intervals(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 30)
    people = spark.createDataFrame([(k, int(y[k])) for k in range(30)], "row_pos long, y int")
    mean = spark.createDataFrame([(m, k, float(rng.random())) for m in ("C", "CP", "CT", "CPT") for k in range(30)], "model string, row_pos long, p double").join(people, "row_pos")
    drawn, intervals = protocol.four_model_intervals(people, mean, 15, 4)
    assert drawn.count() == 4 * 15 and intervals.count() == 8
    with pytest.raises(ContractError, match="differ"):
        # one of the core models has another prediction whenever it is read
        protocol.four_model_intervals(people, mean.withColumn("p", F.when(F.col("model") == "CP", F.expr("(unix_micros(now()) % 1000003 + row_pos * 7919) % 1009 / 1009.0")).otherwise(F.col("p"))), 15, 4)
