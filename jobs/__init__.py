"""Runnable jobs over plain paths, and the queries that run each of them twice into one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import cohort_report, region_intake

from cohortloom.sources.workspace import shared_folder


def job1_cohort_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all labelled documents, made twice in one place."""
    output = shared_folder(spark, "job1")
    for _ in range(2):
        cohort_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", output)
    return spark.read.schema(cohort_report.SCHEMA).parquet(f"{output}/report")


def job2_region_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measurements taken in by the first run; the second, on the same checkpoint, finds nothing new and makes the same nodes."""
    output = shared_folder(spark, "job2")
    for _ in range(2):
        region_intake.run(spark, f"{sf_dir}/lineitem.parquet", *(f"{sf_dir}/{t}.parquet" for t in ("supplier", "nation", "region")), output)
    return spark.read.schema(region_intake.NODES).parquet(f"{output}/nodes")


QUERIES = {f.__name__: f for f in (job1_cohort_report, job2_region_intake)}
SQL = {"job1_cohort_report": cohort_report.SQL, "job2_region_intake": region_intake.SQL}
