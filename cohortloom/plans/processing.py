"""Predictions from several processings of the same measurements: every variant's CP and CPT model on one shared plan.

Only the regional columns change from variant to variant; clinical and structural columns, people and plan stay. All models
are tasks of one run, so a person's row, which has the columns of all variants, meets the plan once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import finite
from cohortloom.operators import metrics, resampling
from cohortloom.operators.contracts import ContractError
from cohortloom.plans.families import VARIANTS, processing_comparisons, processing_models
from cohortloom.plans.prediction import Settings, results, run_nested
from cohortloom.sources.workspace import written


def variant_faults(variants: DataFrame, cohort: DataFrame, pet: list[str], names: tuple[str, ...] = VARIANTS[1:]) -> DataFrame:
    """variant, missing, unknown, repeated, not_finite: people that a variant doesn't have, has without the cohort, or has twice, and rows with a value that isn't finite.

    A declared variant without rows misses everyone; one that isn't declared has unknown people alone.
    """
    sides = variants.select("variant", "row_pos", F.lit(1).alias("_has"), (~_all_finite(pet)).cast("int").alias("_bad"), F.lit(0).alias("_due"))
    due = cohort.select(F.explode(F.array(*[F.lit(v) for v in names])).alias("variant"), "row_pos", F.lit(0).alias("_has"), F.lit(0).alias("_bad"), F.lit(1).alias("_due"))
    people = sides.unionByName(due).groupBy("variant", "row_pos").agg(F.sum("_has").alias("_has"), F.sum("_bad").alias("_bad"), F.sum("_due").alias("_due"))
    has, wanted = F.col("_has") > 0, F.col("_due") > 0
    return people.groupBy("variant").agg(F.count_if(wanted & ~has).alias("missing"), F.count_if(has & ~wanted).alias("unknown"), F.count_if(F.col("_has") > 1).alias("repeated"), F.sum("_bad").alias("not_finite"))


def _all_finite(columns: list[str]):
    out = F.lit(True)
    for c in columns:
        out = out & finite(F.col(c))
    return out


def run_processing(cohort: DataFrame, variants: DataFrame, plan: DataFrame, column_sets: dict[str, list[str]], pet: list[str], binary: set[str], settings: Settings = Settings(), names: tuple[str, ...] = VARIANTS[1:]) -> DataFrame:
    """RESULT rows of the CP and CPT model of every variant, written once; any task that fails, or a grid with a score that isn't finite, fails the family.

    variants: variant, row_pos and the columns of pet, for each variant everyone of the cohort once.
    """
    bad = variant_faults(variants, cohort, pet, names).where("missing + unknown + repeated + not_finite > 0").orderBy("variant").limit(5).collect()
    if bad:
        raise ContractError(f"tables of variants aren't complete: {[tuple(r) for r in bad]}")
    wide = variants.groupBy("row_pos").pivot("variant", list(names)).agg(*[F.first(c).alias(c) for c in pet])
    shared = sorted({c for m in ("CP", "CPT") for c in column_sets[m]} - set(pet))
    people = cohort.select("row_pos", "y", *shared).join(wide, "row_pos")
    # with one aggregate a pivoted column has the variant's name alone
    source = lambda v, c: (f"{v}_{c}" if len(pet) > 1 else v) if c in pet else c
    columns = {name: {c: source(v, c) for c in taken} for name, v, _, taken in processing_models(column_sets, names)}
    got = results(written(run_nested(people, plan, columns, binary, settings), "processing"))
    odd = candidates(got).where(~(finite(F.col("brier")) & finite(F.col("auc")))).select("model", "repeat", "fold").distinct().limit(5).collect()
    if odd:
        raise ContractError(f"a grid has scores that aren't finite: {[tuple(r) for r in odd]}")
    return got


def candidates(predictions: DataFrame) -> DataFrame:
    """model, repeat, fold, c, l1, brier, auc, briers, aucs, chosen: every pair of every task's grid, with mean and single scores of its inner folds."""
    rows = predictions.where("candidates is not null").select("model", "repeat", "fold", F.col("c").alias("_c"), F.col("l1").alias("_l1"), F.inline("candidates"))
    return rows.select("model", "repeat", "fold", "c", "l1", "brier", "auc", "briers", "aucs", ((F.col("c") == F.col("_c")) & (F.col("l1") == F.col("_l1"))).alias("chosen"))


def choice_faults(grid: DataFrame) -> DataFrame:
    """model, tasks, wrong: tasks whose chosen pair isn't the smallest C, then l1, of those within 1e-8 of the least mean Brier score."""
    keys = ["model", "repeat", "fold"]
    low = grid.groupBy(*keys).agg(F.min("brier").alias("_low"))
    near = grid.join(low, keys).groupBy(*keys).agg(F.min(F.when(F.col("brier") <= F.col("_low") + 1e-8, F.struct("c", "l1"))).alias("_best"), F.max(F.when(F.col("chosen"), F.struct("c", "l1"))).alias("_taken"), F.count_if("chosen").alias("_n"))
    return near.groupBy("model").agg(F.count(F.lit(1)).alias("tasks"), F.count_if((F.col("_n") != 1) | (F.col("_best") != F.col("_taken"))).alias("wrong"))


def agreements(predictions: DataFrame) -> DataFrame:
    """model, tests, train, objective: the largest differences from independent fits, in tested and in training probabilities, and of objectives."""
    return predictions.groupBy("model").agg(F.max("agreement").alias("tests"), F.max("train_agreement").alias("train"), F.max("objective_difference").alias("objective"))


def compared(predictions: DataFrame, core: DataFrame, people: DataFrame, draws: int = 2000, seed: int = 20260910, names: tuple[str, ...] = VARIANTS[1:]) -> DataFrame:
    """a, b, metric, difference, lo, hi of all comparisons, a less b for both measures, with intervals of people drawn once for all.

    core: model (CORE_C, CORE_CP, CORE_CPT), repeat, row_pos, p of the original models, which aren't fitted again; people: row_pos, y.
    A comparison whose models aren't all there fails.
    """
    spark = predictions.sparkSession
    pairs = processing_comparisons(names)
    short = ["model", "repeat", "row_pos", "p"]
    mean = written(metrics.mean_predictions(predictions.select(*short).unionByName(core.select(*short))).join(people, "row_pos"), "means")
    lost = {m for p in pairs for m in p} - {r[0] for r in mean.select("model").distinct().limit(100).collect()}
    if lost:
        raise ContractError(f"no predictions of {sorted(lost)}")
    drawn = resampling.weighted_metrics(mean, people, draws, seed)
    listed = spark.createDataFrame([(b, a) for a, b in pairs], "base string, added string")
    intervals = resampling.difference_intervals(resampling.paired_differences(drawn, listed, brier_sign=1))
    seen = metrics.measures(mean, "y", "p", ["model"]).unpivot(["model"], ["auc", "brier"], "metric", "value")
    one = seen.select(F.col("model").alias("added"), "metric", F.col("value").alias("_a"))
    two = seen.select(F.col("model").alias("base"), "metric", F.col("value").alias("_b"))
    both = listed.join(one, "added").join(two, ["base", "metric"]).join(intervals.select("base", "added", "metric", "lo", "hi"), ["base", "added", "metric"], "left")
    return both.select(F.col("added").alias("a"), F.col("base").alias("b"), "metric", (F.col("_a") - F.col("_b")).alias("difference"), "lo", "hi")
