"""The processing engine against plain loops over parts, and its contracts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import elastic_net, splits
from cohortloom.operators.contracts import ContractError
from cohortloom.plans import processing
from cohortloom.plans.prediction import Settings, placed, run_nested

NAMES = ("wholeBrain", "same_seg_noPVC", "PVC5.4")
SETS = {"C": ["age"], "CP": ["age", "a", "b"], "CPT": ["age", "a", "b", "t"]}
SMALL = Settings(c_grid=(0.1, 1.0), l1_grid=(0.0, 1.0))


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(8)
    n = 54
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + x[:, 1] + rng.normal(size=n) > 0).astype(int)
    cohort = spark.createDataFrame([(k, int(y[k]), float(x[k, 2]), None if k == 4 else float(x[k, 3]), 0.0, 0.0) for k in range(n)], "row_pos long, y int, age double, t double, a double, b double")
    pet = {v: x[:, :2] + 0.2 * i * rng.normal(size=(n, 2)) for i, v in enumerate(NAMES)}
    variants = spark.createDataFrame([(v, k, *map(float, z[k])) for v, z in pet.items() for k in range(n)], "variant string, row_pos long, a double, b double")
    plan = splits.nested(splits.stratified(cohort, "y", 3, 1, 5), "y", 3, 6)
    return cohort, variants, plan, pet, x, y


def test_candidates_and_choices_equal_loops(spark, study):
    cohort, variants, plan, pet, x, y = study
    got = processing.run_processing(cohort, variants, plan, SETS, ["a", "b"], set(), SMALL, NAMES)
    assert got.count() == 6 * len(y) and got.select("model").distinct().count() == 6
    grid = {(r.model, r.fold, r.c, r.l1): r for r in processing.candidates(got).collect()}
    assert len(grid) == 6 * 3 * 4 and sum(r.chosen for r in grid.values()) == 18
    assert all(r.wrong == 0 and r.tasks == 3 for r in processing.choice_faults(processing.candidates(got)).collect())
    assert all(max(r.tests, r.train) <= 1e-5 and r.objective <= 1e-10 for r in processing.agreements(got).collect())
    parts = {}
    for r in plan.where("fold = 1").collect():
        parts.setdefault((r.role, r.inner_fold), []).append(r.row_pos)
    at = {k: sorted(v) for k, v in parts.items()}
    t = np.where(np.arange(len(y)) == 4, np.nan, x[:, 3])
    for v in ("wholeBrain", "PVC5.4"):
        whole = np.column_stack([x[:, 2], pet[v], t])
        for c in SMALL.c_grid:
            for l1 in SMALL.l1_grid:
                briers, aucs = [], []
                for k in range(3):
                    tr, va = at["inner_train", k], at["validation", k]
                    prep = elastic_net.prepare(whole[tr], np.zeros(4, bool))
                    p = elastic_net.fit(prep(whole[tr]), y[tr], c, l1).probabilities(prep(whole[va]))
                    briers.append(np.mean((p - y[va]) ** 2))
                    pairs = [(p[i] > p[j]) + 0.5 * (p[i] == p[j]) for i in range(len(va)) for j in range(len(va)) if y[va[i]] > y[va[j]]]
                    aucs.append(np.mean(pairs))
                r = grid[f"{v}_CPT", 1, c, l1]
                assert r.briers == pytest.approx(briers, abs=1e-8) and r.aucs == pytest.approx(aucs, abs=1e-8)
                assert (r.brier, r.auc) == pytest.approx((np.mean(briers), np.mean(aucs)), abs=1e-8)


def test_comparisons_have_every_pair(spark, study):
    cohort, variants, plan, *_ = study
    got = processing.run_processing(cohort, variants, plan, SETS, ["a", "b"], set(), SMALL, NAMES)
    original = cohort.drop("a", "b").join(variants.where("variant = 'wholeBrain'").drop("variant"), "row_pos")
    core = run_nested(original, plan, {f"CORE_{m}": c for m, c in SETS.items()}, set(), SMALL)
    out = processing.compared(got, core, cohort.select("row_pos", "y"), 40, 3, NAMES).collect()
    pairs = {(r.a, r.b) for r in out}
    assert len(out) == 2 * len(pairs) and ("PVC5.4_CPT", "PVC5.4_CP") in pairs and ("wholeBrain_CP", "CORE_C") in pairs
    # the first variant's values are the original's: its models are the same fits
    same = [r for r in out if r.a in ("wholeBrain_CP", "wholeBrain_CPT") and r.b.startswith("CORE_CP")]
    assert len(same) == 4 and all((r.difference, r.lo, r.hi) == pytest.approx((0, 0, 0), abs=1e-12) for r in same)
    with pytest.raises(ContractError, match="CORE_C"):
        processing.compared(got, core.where("model <> 'CORE_C'"), cohort.select("row_pos", "y"), 4, 3, NAMES)


def test_incomplete_variants_fail(spark, study):
    cohort, variants, plan, *_ = study
    extra = spark.createDataFrame([("PVC5.4", 3, 0.0, 0.0), ("PVC5.4", 999, 0.0, float("nan")), ("other", 1, 0.0, 0.0)], variants.schema)
    short = variants.where("not (variant = 'wholeBrain' and row_pos < 2)").union(extra)
    told = {r.variant: tuple(r)[1:] for r in processing.variant_faults(short, cohort, ["a", "b"], NAMES).collect()}
    assert told == {"wholeBrain": (2, 0, 0, 0), "same_seg_noPVC": (0, 0, 0, 0), "PVC5.4": (0, 1, 1, 1), "other": (0, 1, 0, 0)}
    with pytest.raises(ContractError, match="complete"):
        processing.run_processing(cohort, short, plan, SETS, ["a", "b"], set(), SMALL, NAMES)


def test_a_split_has_each_row_once(spark, study):
    _, _, plan, *_ = study
    rows = placed(plan.union(plan.limit(5))).collect()
    assert len(rows) == 3 * 54
    for r in rows:
        assert r.trains != r.tests and (r.fits_in | r.judged_in, r.fits_in & r.judged_in) == ((7, 0) if r.trains else (0, 0))
    with pytest.raises(Exception, match="0 to 62"):
        placed(plan.withColumn("inner_fold", F.col("inner_fold") + 70)).collect()
