"""Shared resampling: one table of drawn rows serves every model and metric.

A draw table is (draw, pos, row_pos). Tables of draws are joined once with the
predictions of all models; draws of one class are skipped and counted, never redrawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.operators.metrics import auc, brier, percentile_interval
from cohortloom.operators.ranking import _bucketed, numbered
from cohortloom.operators.weights import weight_vectors, weights
from cohortloom.sources.workspace import written


def numpy_draws(spark: SparkSession, draws: int, n: int, seed: int) -> DataFrame:
    """draws x n rows drawn with replacement by NumPy's PCG64, draw after draw; meant for small cohorts."""
    rows = np.random.default_rng(seed).integers(0, n, size=(draws, n))
    table = pd.DataFrame({"draw": np.repeat(np.arange(draws), n), "pos": np.tile(np.arange(n), draws), "row_pos": rows.ravel()})
    return spark.createDataFrame(table, "draw long, pos long, row_pos long")


def congruential_draws(spark: SparkSession, draws: int, n: int, a: int = 7919, b: int = 104729, c: int = 31) -> DataFrame:
    """The deterministic draw (a draw + b pos + c draw pos) mod n, made where it is used."""
    base = spark.range(draws * n).select(F.expr(f"id div {n}").alias("draw"), (F.col("id") % n).alias("pos"))
    return base.withColumn("row_pos", (a * F.col("draw") + b * F.col("pos") + c * F.col("draw") * F.col("pos")) % n)


def weighted_draws(ids: DataFrame, draws: int, seed: int) -> DataFrame:
    """draw, pos, row_pos: multinomial draws of the rows of ids (row_pos, of any numbers), each made by the task that has the row's block; pos numbers a person's copies."""
    numbered_ids = numbered(ids.select("row_pos"), [], "row_pos", [], "_k").select((F.col("_k") - 1).alias("_at"), "row_pos")
    made = weights(ids.sparkSession, ids.count(), draws, seed).withColumnRenamed("row_pos", "_at")
    return made.join(numbered_ids, "_at").select("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("weight"))).alias("pos"), "row_pos")


def out_of_bag(draws: DataFrame, rows: DataFrame) -> DataFrame:
    """draw, row_pos of rows that a draw doesn't have."""
    # one row with the draws' numbers, as many as the analysis asks for, meets every row
    numbers = draws.agg(F.collect_set("draw").alias("_draws"))
    every = rows.select("row_pos").crossJoin(numbers).select(F.explode("_draws").alias("draw"), "row_pos")
    return every.join(draws.select("draw", "row_pos").distinct(), ["draw", "row_pos"], "left_anti")


def draw_metrics(draws: DataFrame, predictions: DataFrame) -> DataFrame:
    """draw, model, auc, brier over each draw's rows. predictions: model, row_pos, y, p."""
    drawn = draws.join(predictions, "row_pos")
    keys = ["draw", "model"]
    return drawn.groupBy(*keys).agg(brier(F.col("y"), F.col("p")).alias("brier")).join(auc(drawn, "y", "p", keys), keys).select(*keys, "auc", "brier")


#: Rows whose weights are summed at once.
STRETCH = 1024


def _bucket_sums(draws: int):
    """The function of rows (model, _bucket, p, y, w) in this order: for each model and bucket, by draw, how many positive and negative
    rows, twice their pairs in order (ties once) and the squared errors. It keeps one vector of each, whatever a bucket's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["model", "_bucket", "pos", "neg", "twice", "errors"]
        key = value = tied = None
        sums = np.zeros((3, draws), np.int64)
        errors = np.zeros(draws)

        def closed() -> None:
            """The rows of the last value meet what is below them."""
            if tied is not None:
                sums[2] += tied[0] * (2 * sums[1] + tied[1])
                sums[:2] += tied

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), *[pa.array([v.tolist()]) for v in (*sums, errors)]], names)

        for b in batches:
            model, bucket = b.column(0).to_pylist(), b.column(1).to_numpy()
            p, y = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            w = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(p), draws)
            new = np.array([True, *(m != n or c for m, n, c in zip(model[1:], model, np.diff(bucket) != 0))]) if len(p) else np.zeros(0, bool)
            cuts = np.union1d(np.flatnonzero(new), np.arange(0, len(p), STRETCH))
            for low, high in zip(cuts, (*cuts[1:], len(p))):
                if key != (model[low], bucket[low]):
                    if key is not None:
                        closed()
                        yield told()
                    key, value, tied = (model[low], bucket[low]), None, None
                    sums, errors = np.zeros((3, draws), np.int64), np.zeros(draws)
                x, q = w[low:high].astype(np.int64), p[low:high]
                errors += (q - y[low:high]) ** 2 @ x
                first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
                classes = np.stack([np.add.reduceat(x * (y[low:high] == k)[:, None], first, axis=0) for k in (1, 0)], axis=1)
                if value is not None and q[0] == value:
                    classes[0] += tied
                else:
                    closed()
                # all but the last value are complete
                done = classes[:-1]
                below = sums[1] + np.cumsum(done[:, 1], axis=0) - done[:, 1]
                sums[2] += (done[:, 0] * (2 * below + done[:, 1])).sum(axis=0)
                sums[:2] += done.sum(axis=0)
                value, tied = q[-1], classes[-1]
        if key is not None:
            closed()
            yield told()

    return run


def weighted_metrics(predictions: DataFrame, people: DataFrame, draws: int, seed: int) -> DataFrame:
    """draw, model, auc, brier of draw_metrics() over weighted_draws() of people (row_pos), without a row for each draw and person; written once.

    predictions: model, row_pos, y, p. A model's order by p is the same in all draws: its rows are dealt in that order, each with its
    weights by draw, and a bucket of p hands on one vector of sums. Only these vectors meet by draw.
    """
    predictions = written(predictions.select("model", "row_pos", F.col("y").cast("int").alias("y"), F.col("p").cast("double").alias("p")), "predictions")
    ids = written(numbered(people.select("row_pos"), [], "row_pos", [], "_k").select((F.col("_k") - 1).alias("_at"), "row_pos"), "ids")
    rows = _bucketed(predictions.join(ids, "row_pos").select("_at", "model", "y", "p"), ["model"], "p").select("_at", "model", "_bucket", "p", "y")
    rows = weight_vectors(rows, "_at", ids.count(), draws, seed)
    rows = rows.repartition("model", "_bucket").sortWithinPartitions("model", "_bucket", "p")
    made = rows.mapInArrow(_bucket_sums(draws), "model string, _bucket long, pos array<long>, neg array<long>, twice array<long>, errors array<double>")
    each = made.select("model", "_bucket", F.posexplode(F.arrays_zip("pos", "neg", "twice", "errors")).alias("draw", "_v")).select("model", "_bucket", F.col("draw").cast("long").alias("draw"), "_v.*")
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("model", "draw").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = each.withColumn("_below", below).groupBy("draw", "model").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.sum(F.col("twice") + 2 * F.col("pos") * F.col("_below")).alias("_t"), F.sum("errors").alias("_e"))
    a, b = F.col("_p"), F.col("_n")
    return written(sums.select("draw", "model", F.when((a > 0) & (b > 0), F.col("_t") / (2 * a * b)).alias("auc"), (F.col("_e") / (a + b)).alias("brier")), "draws")


def model_intervals(metrics: DataFrame) -> DataFrame:
    """model, metric, valid_draws, skipped, lo, hi: draws with a null AUC (one class) are skipped for both metrics."""
    counts = metrics.groupBy("model").agg(F.count("auc").alias("valid_draws"), F.count_if(F.col("auc").isNull()).alias("skipped"))
    long = metrics.where("auc is not null").unpivot(["draw", "model"], ["auc", "brier"], "metric", "value")
    return percentile_interval(long, "value", ["model", "metric"], bounded=True).join(counts, "model")


def paired_differences(metrics: DataFrame, pairs: DataFrame, brier_sign: int = -1) -> DataFrame:
    """base, added, draw, auc and brier differences of (base, added) pairs: AUC added - base; Brier base - added
    (brier_sign -1) or added - base (1)."""
    ok = metrics.where("auc is not null")
    one = ok.select("draw", F.col("model").alias("base"), F.col("auc").alias("a0"), F.col("brier").alias("b0"))
    two = ok.select("draw", F.col("model").alias("added"), F.col("auc").alias("a1"), F.col("brier").alias("b1"))
    both = F.broadcast(pairs).join(one, "base").join(two, ["draw", "added"])
    return both.select("base", "added", "draw", (F.col("a1") - F.col("a0")).alias("auc"), (brier_sign * (F.col("b1") - F.col("b0"))).alias("brier"))


def difference_intervals(differences: DataFrame) -> DataFrame:
    long = differences.unpivot(["base", "added", "draw"], ["auc", "brier"], "metric", "value")
    return percentile_interval(long, "value", ["base", "added", "metric"], bounded=True)


def optimism(draws: DataFrame, apparent_auc: float, apparent_brier: float) -> DataFrame:
    """One row of mean optimism and corrected values from (bag_auc, original_auc, bag_brier, original_brier):
    AUC loses bag - original, Brier gains original - bag."""
    means = draws.agg(F.avg(F.col("bag_auc") - F.col("original_auc")).alias("auc_optimism"), F.avg(F.col("original_brier") - F.col("bag_brier")).alias("brier_optimism"))
    return means.withColumn("corrected_auc", F.lit(apparent_auc) - F.col("auc_optimism")).withColumn("corrected_brier", F.lit(apparent_brier) + F.col("brier_optimism"))
