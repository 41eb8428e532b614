"""Ablations on a supplied plan, draws of people of any numbers, and families with ties, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import ranking, resampling, splits
from cohortloom.operators.contracts import ContractError
from cohortloom.operators.linear import rank_auc
from cohortloom.operators.weights import block_weights
from cohortloom.plans.prediction import Settings, run_ablations


def test_ablations_share_plan_and_draws(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=60) > 0).astype(int)
    cohort = spark.createDataFrame([(3 * k + 5, int(y[k]), *map(float, x[k])) for k in range(60)], "row_pos long, y int, a double, b double, c double")
    plan = splits.nested(splits.stratified(cohort, "y", 3, 1, 5), "y", 3, 6)
    out = run_ablations(cohort, plan, ["c"], {"first": ["a"], "second": ["b"]}, set(), Settings(c_grid=(0.1, 1.0), l1_grid=(0.0,)), draws=30, seed=9)
    got = out["predictions"]
    assert {r.model for r in got.select("model").distinct().collect()} == {"full", "without_first", "without_second", "without_both"}
    assert got.count() == 4 * 60 and got.where("status <> 'PASS'").count() == 0
    p = {m: np.array([r.p for r in got.where(F.col("model") == m).orderBy("row_pos").collect()]) for m in ("full", "without_first")}
    r = {(r.base, r.metric): r for r in out["comparisons"].collect()}
    assert len(r) == 6
    auc = rank_auc(y, p["full"]) - rank_auc(y, p["without_first"])
    brier = np.mean((p["full"] - y) ** 2) - np.mean((p["without_first"] - y) ** 2)
    assert (r["without_first", "auc"].difference, r["without_first", "brier"].difference) == pytest.approx((auc, brier))
    w = block_weights(0, 60, 30, 9)
    drawn = []
    for k in range(30):
        at = np.repeat(np.arange(60), w[k])
        if len(set(y[at])) == 2:
            drawn.append([rank_auc(y[at], p["full"][at]) - rank_auc(y[at], p["without_first"][at]), np.mean((p["full"][at] - y[at]) ** 2) - np.mean((p["without_first"][at] - y[at]) ** 2)])
    low, high = np.quantile(drawn, [0.025, 0.975], axis=0)
    for k, metric in enumerate(("auc", "brier")):
        assert (r["without_first", metric].lo, r["without_first", metric].hi) == pytest.approx((low[k], high[k]))
    with pytest.raises(ContractError):
        run_ablations(cohort, plan, ["c"], {"first": ["a"]}, set())


def test_draws_have_every_place(spark):
    ids = spark.createDataFrame([(7 * k + 2,) for k in range(25)], "row_pos long")
    rows = resampling.weighted_draws(ids, 6, 3).collect()
    assert len(rows) == 6 * 25 and {r.row_pos for r in rows} <= {7 * k + 2 for k in range(25)}
    assert len({(r.draw, r.row_pos, r.pos) for r in rows}) == len(rows)


def test_families_with_ties_and_gaps_in_keys(spark):
    rng = np.random.default_rng(6)
    groups = {None: rng.random(70).round(1), "a": np.full(300, 1.0), "b": rng.random(500) ** 3, "c": np.array([0.0, 0.0, 1.0])}
    df = spark.createDataFrame([(g, k, float(p)) for g, ps in groups.items() for k, p in enumerate(ps)], "family string, k long, p double")
    up = {(r.family, r.k): r.q for r in ranking.benjamini_hochberg(df, "p", ["family"], ["k"]).collect()}
    down = {(r.family, r.k): r.p_holm for r in ranking.holm(df, "p", ["family"], ["k"]).collect()}
    for g, p in groups.items():
        order, m = np.argsort(p, kind="stable"), len(p)
        bh = np.minimum.accumulate((p[order] * m / np.arange(1, m + 1))[::-1])[::-1].clip(max=1)
        holm = np.maximum.accumulate(np.minimum(1, p[order] * np.arange(m, 0, -1)))
        assert [up[g, int(k)] for k in order] == pytest.approx(bh.tolist()) and [down[g, int(k)] for k in order] == pytest.approx(holm.tolist())


@pytest.mark.parametrize("stretch", [3, 1024])
def test_weighted_metrics_equal_those_of_drawn_rows(spark, monkeypatch, stretch):
    """Ties within and across stretches and buckets, gaps in row numbers, draws of one class."""
    monkeypatch.setattr(resampling, "STRETCH", stretch)
    rng = np.random.default_rng(12)
    y = (rng.random(50) < 0.1).astype(int)
    p = {"a": rng.random(50).round(1), "b": np.full(50, 0.25), "c": rng.random(50) ** 9}
    rows = spark.createDataFrame([(m, 11 * k + 3, int(y[k]), float(v[k])) for m, v in p.items() for k in range(50)], "model string, row_pos long, y int, p double")
    people = rows.select("row_pos").distinct()
    got = {(r.draw, r.model): (r.auc, r.brier) for r in resampling.weighted_metrics(rows, people, 40, 2).collect()}
    want = {(r.draw, r.model): (r.auc, r.brier) for r in resampling.draw_metrics(resampling.weighted_draws(people, 40, 2), rows).collect()}
    assert got.keys() == want.keys() and len(got) == 120 and any(a is None for a, _ in got.values())
    for k, (a, b) in got.items():
        assert (a is None) == (want[k][0] is None) and b == pytest.approx(want[k][1]) and (a is None or a == pytest.approx(want[k][0]))


def test_draws_are_not_broadcast(spark):
    """Spark takes weights for small, whatever their number: a join with them must not go through the driver."""
    ids = spark.createDataFrame([(k,) for k in range(25)], "row_pos long")
    plan = resampling.weighted_draws(ids, 6, 3)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_at" in line and "_bucket" not in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
