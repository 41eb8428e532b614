"""Incremental intake of labelled measurements: sums of what is new, then node means and quality states of all.

    python -m jobs.region_intake MEASUREMENTS SUPPLIER NATION REGION OUTPUT [--config jobs/region_intake.json]

MEASUREMENTS is a folder of Parquet files (or one file) that grows; supplier,
nation and region give each label its side, node and composite. A file stream
with a checkpoint in OUTPUT/checkpoint takes the files that no run before has
taken. Each of its batches adds up its measurements by subject and label and
writes these few rows to OUTPUT/sums/batch=N, a partition that a repeat of the
batch after a failure overwrites; sums are decimals, so that neither the order of
files nor their division into batches matters. Then all sums, not measurements,
are added up to OUTPUT/nodes, a folder for each composite, with the left, right
and pooled mean of each node, its asymmetry and its quality state. A run without
new files makes the same nodes.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import regional

log = logging.getLogger("jobs.region_intake")
TOTAL = "decimal(38,6)"
SUMS = f"subject string, label long, measured long, valid long, total {TOTAL}, batch long"
NODES = "subject string, node string, left double, right double, pooled double, asymmetry double, status string, composite string"


@dataclass(frozen=True)
class Config:
    subject: str = "l_returnflag"
    label: str = "l_suppkey"
    value: str = "l_extendedprice"
    columns: str = "l_returnflag string, l_suppkey bigint, l_extendedprice double"
    files_per_batch: int = 1000

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Config:
        return cls(**json.loads(spark.read.text(path, wholetext=True).first()[0]))


def pattern(path: str) -> str:
    """The path as a pattern that it alone matches: a file stream takes a single file only by a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def take(spark: SparkSession, measurements: str, output: str, config: Config) -> int:
    """Adds the sums of new files to output/sums; returns the number of new measurements."""
    rows = 0

    def batch(df: DataFrame, number: int) -> None:
        nonlocal rows
        taken = df.select(F.col(config.subject).cast("string").alias("subject"), F.col(config.label).cast("long").alias("label"), F.col(config.value).alias("value"))
        sums = regional.label_sums(taken, ["subject"], "value", TOTAL).withColumn("batch", F.lit(number))
        sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/sums")
        n = spark.read.schema(SUMS).parquet(f"{output}/sums").where(F.col("batch") == number).agg(F.coalesce(F.sum("measured"), F.lit(0))).first()[0]
        log.info("batch %s: %s measurements", number, n)
        rows += n

    new = spark.readStream.schema(config.columns).option("maxFilesPerTrigger", config.files_per_batch).parquet(pattern(measurements))
    stream = new.writeStream.foreachBatch(batch).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return rows


def hierarchy(spark: SparkSession, supplier: str, nation: str, region: str) -> DataFrame:
    """label, side, node, composite: even labels are left."""
    s, n, r = (spark.read.parquet(p) for p in (supplier, nation, region))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("s_suppkey").alias("label"), F.when(F.col("s_suppkey") % 2 == 0, "L").otherwise("R").alias("side"), F.col("n_name").alias("node"), F.col("r_name").alias("composite"))


def nodes(sums: DataFrame, labels: DataFrame) -> DataFrame:
    """NODES of all batches' sums."""
    whole = sums.groupBy("subject", "label").agg(F.sum("measured").alias("measured"), F.sum("valid").alias("valid"), F.sum("total").cast(TOTAL).alias("total"))
    return regional.nodes_of(whole, labels, ["subject"])


def run(spark: SparkSession, measurements: str, supplier: str, nation: str, region: str, output: str, config: Config = Config()) -> None:
    """Takes what is new at the path of measurements and makes output/nodes anew."""
    rows = take(spark, measurements, output, config)
    log.info("read %s new measurements from %s", rows, measurements)
    # an empty write makes the folder where no file has come yet
    spark.createDataFrame([], SUMS).write.mode("append").partitionBy("batch").parquet(f"{output}/sums")
    made = nodes(spark.read.schema(SUMS).parquet(f"{output}/sums"), hierarchy(spark, supplier, nation, region))
    made.repartition("composite").sortWithinPartitions("subject", "node").write.mode("overwrite").partitionBy("composite").parquet(f"{output}/nodes")
    log.info("wrote %s nodes to %s/nodes", spark.read.schema(NODES).parquet(f"{output}/nodes").count(), output)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("measurements", "supplier", "nation", "region", "output"):
        parser.add_argument(name)
    parser.add_argument("--config", default=Path(__file__).with_suffix(".json").as_uri())
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("region_intake").getOrCreate()
    try:
        run(spark, args.measurements, args.supplier, args.nation, args.region, args.output, Config.read(spark, args.config))
    finally:
        spark.stop()


#: Nodes of the default settings; values have two decimals, and sums of whole hundredths are exact as the job's are.
SQL = """
WITH v AS (SELECT l_suppkey AS label, l_extendedprice AS pet, l_returnflag AS subject FROM lineitem),
h AS (SELECT s_suppkey AS label, s_suppkey % 2 = 0 AS l, n_name AS node, r_name AS composite FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT * FROM (SELECT DISTINCT subject FROM v JOIN h USING (label)), (SELECT DISTINCT composite, node FROM h)),
a AS (SELECT subject, composite, node, l, count(*) AS n, count(*) FILTER (pet > 0 AND isfinite(pet)) AS k, sum(CAST(round(pet * 100) AS BIGINT)) FILTER (pet > 0 AND isfinite(pet)) AS h FROM v JOIN h USING (label) GROUP BY ALL),
w AS (SELECT e.subject, e.composite, e.node, side, coalesce(sum(n) FILTER (side = 'p' OR l = (side = 'l')), 0) AS n, coalesce(sum(k) FILTER (side = 'p' OR l = (side = 'l')), 0) AS k, CAST(sum(h) FILTER (side = 'p' OR l = (side = 'l')) AS DOUBLE) / 100 AS s
  FROM e CROSS JOIN (SELECT unnest(['l', 'r', 'p']) AS side) LEFT JOIN a USING (subject, composite, node) GROUP BY ALL),
t AS (SELECT *, CASE WHEN n < 10 OR k / n < 0.8 THEN 2 WHEN n <= 24 OR k / n < 0.95 THEN 1 ELSE 0 END AS sev FROM w),
p AS (SELECT subject, composite, node, any_value(s / k) FILTER (side = 'l' AND sev < 2) AS l, any_value(s / k) FILTER (side = 'r' AND sev < 2) AS r, any_value(s / k) FILTER (side = 'p' AND sev < 2) AS p, max(sev) AS sev FROM t GROUP BY ALL)
SELECT subject, node, l AS "left", r AS "right", p AS pooled, 2 * (l - r) / (l + r) AS asymmetry, CASE sev WHEN 2 THEN 'missing' WHEN 1 THEN 'attention' ELSE 'pass' END AS status, composite FROM p
"""

if __name__ == "__main__":
    main()
