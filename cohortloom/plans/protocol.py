"""A frozen protocol in three steps: prepare, fit each model, summarize. State passes through tables alone."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import metrics, resampling, splits
from cohortloom.operators.contracts import ContractError
from cohortloom.operators.newton import calibration
from cohortloom.plans.prediction import Settings, results, run_nested
from cohortloom.sources.workspace import written

#: Pairs (base, added) that are compared.
COMPARISONS = (("C", "CT"), ("C", "CP"), ("CP", "CPT"), ("CT", "CPT"))


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: counts and sums of two hashes of each row."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    parts = df.select(F.xxhash64(row).cast("decimal(20,0)").alias("a"), F.crc32(row).alias("b")).agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()
    return ":".join(map(str, parts))


def prepare(cohort: DataFrame, folder: str, settings: Settings, folds: int, strata: str = "y") -> dict:
    """Writes the cohort, its nested plan, cell counts and a manifest of their digests to a fresh folder."""
    spark = cohort.sparkSession
    cohort.write.parquet(f"{folder}/cohort")
    fixed = spark.read.parquet(f"{folder}/cohort")
    plan = splits.nested(splits.stratified(fixed, strata, folds, settings.repeats, settings.seed), strata, settings.inner_folds, settings.seed + 1)
    plan.write.parquet(f"{folder}/plan")
    plan = spark.read.parquet(f"{folder}/plan")
    faults = splits.plan_faults(plan, strata).first()
    if any(faults):
        raise ContractError(f"the plan breaks its contract: {faults}")
    manifest = {"schema_version": 1, "rows": [{"table": t, "digest": table_digest(spark.read.parquet(f"{folder}/{t}"))} for t in ("cohort", "plan")], "settings": json.dumps(vars(settings), sort_keys=True, default=list)}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.text(f"{folder}/manifest")
    return manifest


def verified(spark: SparkSession, folder: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(cohort, plan) of a prepared folder whose tables and settings are still those of its manifest."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    if manifest["settings"] != json.dumps(vars(settings), sort_keys=True, default=list):
        raise ContractError("the settings have changed")
    for r in manifest["rows"]:
        if table_digest(spark.read.parquet(f"{folder}/{r['table']}")) != r["digest"]:
            raise ContractError(f"{r['table']} has changed")
    return spark.read.parquet(f"{folder}/cohort"), spark.read.parquet(f"{folder}/plan")


def fit_model(spark: SparkSession, folder: str, model: str, columns: list[str], binary: set[str], settings: Settings, unpenalized: set[str] = frozenset()) -> DataFrame:
    """Fits one model on the frozen plan; its fresh table keeps failures with their status."""
    cohort, plan = verified(spark, folder, settings)
    out = f"{folder}/fits/{model}"
    run_nested(cohort, plan, {model: columns}, binary, settings, unpenalized).write.parquet(out)
    return spark.read.parquet(out)


def collected(spark: SparkSession, folder: str, models: list[str], settings: Settings) -> DataFrame:
    """All models' predictions, each row tested once in each repeat, or an error."""
    cohort, plan = verified(spark, folder, settings)
    got = results(spark.read.parquet(*[f"{folder}/fits/{m}" for m in models]))
    want = plan.where("role = 'test'").select("repeat", "fold", "row_pos").withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    keys = ["model", "repeat", "fold", "row_pos"]
    off = got.select(*keys, F.lit(1).alias("b")).union(want.select(*keys, F.lit(2))).groupBy(*keys).agg(F.sum("b").alias("b")).where("b <> 3").limit(1).count()
    if off:
        raise ContractError("predictions don't cover the plan exactly once")
    return got


def four_model_intervals(people: DataFrame, mean: DataFrame, draws: int, seed: int, core: tuple[str, ...] = ("C", "CP", "CPT")) -> tuple[DataFrame, DataFrame]:
    """(draw_metrics() of all models, written once; their intervals): people are drawn once for all models, and the core models drawn by
    themselves must have the same intervals, to 1e-12, and numbers of draws."""
    metric = written(resampling.draw_metrics(resampling.weighted_draws(people, draws, seed), mean), "draws")
    every = written(resampling.model_intervals(metric), "intervals")
    alone = resampling.model_intervals(resampling.draw_metrics(resampling.weighted_draws(people, draws, seed), mean.where(F.col("model").isin(*core))))
    one, two = (df.select("model", "metric", F.struct("lo", "hi", "valid_draws", "skipped").alias(c)) for df, c in ((every.where(F.col("model").isin(*core)), "a"), (alone, "b")))
    near = lambda c: F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= 1e-12, F.col(f"a.{c}").isNull() & F.col(f"b.{c}").isNull())
    same = near("lo") & near("hi") & (F.col("a.valid_draws") == F.col("b.valid_draws")) & (F.col("a.skipped") == F.col("b.skipped"))
    off = one.join(two, ["model", "metric"], "full").where(~F.coalesce(same, F.lit(False))).select("model", "metric").limit(5).collect()
    if off:
        raise ContractError(f"intervals differ between runs: {[tuple(r) for r in off]}")
    return metric, every


def summarize(spark: SparkSession, folder: str, models: list[str], settings: Settings, draws: int = 2000, seed: int = 20260910) -> dict[str, DataFrame]:
    """performance, calibration, decision, intervals, comparisons and numerics tables of a complete run."""
    got = collected(spark, folder, models, settings)
    y = got.select("row_pos", "y").distinct()
    mean = metrics.mean_predictions(got).join(y, "row_pos")
    drawn, intervals = four_model_intervals(y, mean, draws, seed)
    pairs = spark.createDataFrame([p for p in COMPARISONS if set(p) <= set(models)], "base string, added string")
    return {
        "performance": metrics.measures(mean, "y", "p", ["model"]),
        "repeats": metrics.measures(got, "y", "p", ["model", "repeat"]),
        "calibration": calibration(mean.select("model", "y", "p"), ["model"]),
        "decision": metrics.decision_curve(mean, "y", "p", list(settings.thresholds), ["model"]),
        "intervals": intervals,
        "comparisons": resampling.difference_intervals(resampling.paired_differences(drawn, pairs)),
        "numerics": got.groupBy("model").agg(F.max("kkt").alias("max_kkt"), F.max("gap").alias("max_gap"), F.max("agreement").alias("max_agreement"), F.sum("fits").alias("fits"), F.count_distinct("c", "l1").alias("choices")),
    }


def comparison_display(comparisons: DataFrame) -> DataFrame:
    """For display a Brier difference is added - base: negated, its bounds swapped."""
    flip = F.col("metric") == "brier"
    return comparisons.select("base", "added", "metric", F.when(flip, -F.col("hi")).otherwise(F.col("lo")).alias("lo"), F.when(flip, -F.col("lo")).otherwise(F.col("hi")).alias("hi"))


def descriptive_display(rows: DataFrame) -> DataFrame:
    """field, level, group_name, shown of a long table of descriptives: numbers to three places, categories as count (percent)."""
    wide = rows.groupBy("group_name", "field", "level").pivot("statistic", ["n", "mean", "sd", "median", "q1", "q3", "count", "percent"]).agg(F.first("value"))
    number = F.format_string("%.3f (%.3f); %.3f [%.3f, %.3f]", "mean", F.coalesce("sd", F.lit(0.0)), "median", "q1", "q3")
    return wide.select("field", "level", "group_name", F.when(F.col("level").isNull(), number).otherwise(F.format_string("%d (%.1f%%)", F.col("count").cast("long"), "percent")).alias("shown"))
