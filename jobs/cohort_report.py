"""The report of a cohort of texts: measures of whole texts, their associations with the outcome, and how a fixed score does.

    python -m jobs.cohort_report DOCUMENTS LABELS OUTPUT [--config jobs/cohort_report.json]

Reads documents (doc_id, text, lang, source) and labels (doc_id and outcomes of 0
or 1). A label without its document, and an outcome that isn't 0 or 1, end the
job. Writes the measures to OUTPUT/cohort and the report to OUTPUT/report, both
Parquet; the report has a folder for each group, with rows (section, item,
statistic, value): performance (n, AUC, Brier score), calibration bins with Wilson
limits, net benefit at each threshold, and for each measure the HC3 comparison of
both outcomes and their descriptive statistics. What can't be estimated, such as
an AUC of one class alone, has no row. A run replaces the output of the one before
it; equal inputs give an equal report.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import columns as C
from cohortloom.functions import text
from cohortloom.operators import assembly, metrics

log = logging.getLogger("jobs.cohort_report")
SCHEMA = "section string, item string, statistic string, value double, group string"
NO_GROUP = "unknown"


@dataclass(frozen=True)
class Config:
    outcome: str = "quality"
    group: str = "lang"
    offset: float = 4.0
    thresholds: tuple[float, ...] = (0.25, 0.5, 0.75)
    digits: int = 6

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Config:
        given = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return cls(**given | ({"thresholds": tuple(given["thresholds"])} if "thresholds" in given else {}))


def cohort(documents: DataFrame, labels: DataFrame, config: Config) -> DataFrame:
    """doc_id, y, group, p and the measures of each label's document."""
    y = labels.select("doc_id", C.strict_binary(F.col(config.outcome), config.outcome).alias("y"))
    found = documents.select("doc_id", F.coalesce(F.col(config.group).cast("string"), F.lit(NO_GROUP)).alias("group"), *[m.alias(n) for n, m in text.measures(F.col("text")).items()])
    aligned = assembly.align(y, found, "doc_id", ["group", *text.measures(F.lit(""))])
    return aligned.withColumn("p", C.expit(F.log1p("n_words") - config.offset))


def _long(df: DataFrame, section: str, item: str | None, statistics: list[str]) -> DataFrame:
    """(group, section, item, statistic, value) of each named column."""
    item = F.lit("all") if item is None else F.col(item).cast("string")
    wide = df.select("group", F.lit(section).alias("section"), item.alias("item"), *[F.col(s).cast("double").alias(s) for s in statistics])
    return wide.unpivot(["group", "section", "item"], statistics, "statistic", "value")


def report(rows: DataFrame, config: Config) -> DataFrame:
    names = list(text.measures(F.lit("")))
    long = rows.unpivot(["group", "y"], names, "measure", "x").where("x is not null")
    by = ["group", "measure"]
    summary = long.groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"))
    parts = [
        _long(metrics.measures(rows, "y", "p", ["group"]), "performance", None, ["n", "auc", "brier"]),
        _long(metrics.calibration_bins(rows, "y", "p", ["group"], metrics.EDGES_DECIMAL), "calibration", "bin", ["n", "responders", "mean_p", "observed", "low", "high"]),
        _long(metrics.decision_curve(rows, "y", "p", list(config.thresholds), ["group"]), "decision", "threshold", ["model", "treat_all"]),
        _long(metrics.two_group_hc3(long, "y", "x", by), "association", "measure", ["difference", "se", "t"]),
        _long(summary, "description", "measure", ["n", "mean", "sd", "min", "max"]),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.where(C.finite(F.col("value"))).withColumn("value", F.round("value", config.digits))


def run(spark: SparkSession, documents: str, labels: str, output: str, config: Config = Config()) -> None:
    """Makes the report of the tables at the paths; output is replaced."""
    # measures are taken of labelled documents alone, and once: five sections read them from a table
    taken = cohort(spark.read.parquet(documents), spark.read.parquet(labels), config)
    taken.write.mode("overwrite").parquet(f"{output}/cohort")
    rows = spark.read.schema(taken.schema).parquet(f"{output}/cohort")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    log.info("read %s labelled documents, %s with outcome 1, from %s and %s", n, positive, documents, labels)
    made = report(rows, config)
    made.repartition("group").sortWithinPartitions("section", "item", "statistic").write.mode("overwrite").partitionBy("group").parquet(f"{output}/report")
    log.info("wrote %s rows to %s/report", spark.read.schema(SCHEMA).parquet(f"{output}/report").count(), output)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "labels", "output"):
        parser.add_argument(name)
    parser.add_argument("--config", default=Path(__file__).with_suffix(".json").as_uri())
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("cohort_report").getOrCreate()
    try:
        run(spark, args.documents, args.labels, args.output, Config.read(spark, args.config))
    finally:
        spark.stop()


_Z = "1.959963984540054"
#: The report of the default settings.
SQL = rf"""
WITH s AS (SELECT l.quality AS y, coalesce(d.lang, 'unknown') AS g, coalesce(d.text, '') AS t FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT y, g, len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) AS w, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS i,
        length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '0123456789', '')) AS o, length(t) - length(replace(t, chr(10), '')) + 1 AS n FROM s),
r AS MATERIALIZED (SELECT y, g, w::DOUBLE AS n_words, i / nullif(w, 0) AS mean_word, n::DOUBLE AS n_lines, (i - o) / nullif(i, 0) AS digit_share, 1 / (1 + exp(-(ln(1 + w) - 4.0::DOUBLE))) AS p FROM c),
k AS (SELECT g, p, count(*) AS n, sum(y) AS k FROM r GROUP BY ALL),
q AS (SELECT g, sum(rk * k) AS s, sum(k) AS a, sum(n) - sum(k) AS b FROM (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY p) - n + (n + 1) / 2 AS rk FROM k) GROUP BY g),
perf AS (SELECT r.g, 'performance' AS section, 'all' AS item, unnest(['n', 'auc', 'brier']) AS statistic, unnest([count(*)::DOUBLE, (any_value(s) - any_value(a) * (any_value(a) + 1) / 2) / nullif(any_value(a) * any_value(b), 0), avg((y - p) * (y - p))]) AS value FROM r JOIN q USING (g) GROUP BY r.g),
bins AS (SELECT g, 1 + (p >= 0.2)::INT + (p >= 0.4)::INT + (p >= 0.6)::INT + (p >= 0.8)::INT AS bin, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS k, avg(p) AS m FROM r GROUP BY ALL),
full_ AS (SELECT e.g, e.bin, coalesce(n, 0) AS n, coalesce(k, 0) AS k, m, k / n AS o FROM (SELECT DISTINCT g, unnest([1, 2, 3, 4, 5]) AS bin FROM r) e LEFT JOIN bins b ON b.g = e.g AND b.bin = e.bin),
cal AS (SELECT g, 'calibration' AS section, bin::VARCHAR AS item, unnest(['n', 'responders', 'mean_p', 'observed', 'low', 'high']) AS statistic,
        unnest([n, k, m, o, CASE WHEN n > 0 THEN greatest(((o + {_Z}*{_Z}/(2*n)) - {_Z}*sqrt(o*(1-o)/n + {_Z}*{_Z}/(4*n*n))) / (1 + {_Z}*{_Z}/n), 0) END, CASE WHEN n > 0 THEN least(((o + {_Z}*{_Z}/(2*n)) + {_Z}*sqrt(o*(1-o)/n + {_Z}*{_Z}/(4*n*n))) / (1 + {_Z}*{_Z}/n), 1) END]) AS value FROM full_),
dec AS (SELECT g, 'decision' AS section, t::VARCHAR AS item, unnest(['model', 'treat_all']) AS statistic, unnest([avg((p >= t AND y = 1)::INT) - avg((p >= t AND y = 0)::INT) * t / (1 - t), avg(y) - (1 - avg(y)) * t / (1 - t)]) AS value FROM r, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS t) GROUP BY g, t),
x AS MATERIALIZED (SELECT g, y, unnest(['n_words', 'mean_word', 'n_lines', 'digit_share']) AS measure, unnest([n_words, mean_word, n_lines, digit_share]) AS x FROM r),
z AS (SELECT * FROM x WHERE x IS NOT NULL),
h AS (SELECT g, measure, avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0) AS d, sqrt(var_samp(x) FILTER (y = 1) / (count(*) FILTER (y = 1) - 1) + var_samp(x) FILTER (y = 0) / (count(*) FILTER (y = 0) - 1)) AS se FROM z GROUP BY ALL),
ass AS (SELECT g, 'association' AS section, measure AS item, unnest(['difference', 'se', 't']) AS statistic, unnest([d, se, d / se]) AS value FROM h),
des AS (SELECT g, 'description' AS section, measure AS item, unnest(['n', 'mean', 'sd', 'min', 'max']) AS statistic, unnest([count(x)::DOUBLE, avg(x), stddev_samp(x), min(x), max(x)]) AS value FROM z GROUP BY g, measure)
SELECT section, item, statistic, round(value, 6) AS value, g AS "group" FROM (SELECT * FROM perf UNION ALL SELECT * FROM cal UNION ALL SELECT * FROM dec UNION ALL SELECT * FROM ass UNION ALL SELECT * FROM des)
WHERE value IS NOT NULL AND isfinite(value)
"""

if __name__ == "__main__":
    main()
