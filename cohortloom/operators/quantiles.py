"""Exact quantiles of groups of any size, by selection.

A quantile needs one or two values of known rank. Buckets of a group's values are
counted, and the running total of their counts, of which a group has some thousand
at most, says which bucket has a rank. Only the values of those buckets go on:
they are counted, bucketed again within their bucket, and summed up in the same
way. No task has a group; most values are read twice and never sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.columns import finite
from cohortloom.operators.ranking import _bucketed, running_sums


def quantiles(df: DataFrame, x: str, by: list[str], probs: list[float], out: str = "q") -> DataFrame:
    """by, n (values that are finite), q: array of their linearly interpolated quantiles, null if there are none."""
    if not probs or not all(0 <= p <= 1 for p in probs):
        raise ValueError("probabilities lie between 0 and 1")
    v = F.col(x).cast("double")
    rows = df.where(finite(v)).select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], v.alias("_v"))
    keys = [f"_g{k}" for k in range(len(by))]
    placed = _bucketed(rows, keys, "_v").withColumnRenamed("_bucket", "_part")
    line = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    parts = parts.withColumn("_from", F.coalesce(F.sum("_c").over(line), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    low = [F.floor((F.col("_n") - 1) * F.lit(float(p))) for p in probs]
    high = [F.ceil((F.col("_n") - 1) * F.lit(float(p))) for p in probs]
    within = lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_c"))
    chosen = parts.where(reduce(lambda a, b: a | b, [within(r) for r in (*low, *high)])).select(*keys, "_part", "_from", "_n")
    kept = _matched(placed, chosen, [*keys, "_part"])
    counts = kept.groupBy(*keys, "_part", "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_from").alias("_from"), F.first("_n").alias("_n"))
    sums = running_sums(counts, [*keys, "_part"], "_v", {"_in": "_c"}).withColumn("_from", F.col("_from") + F.col("_in"))
    pick = lambda r: F.max(F.when(within(r), F.col("_v")))
    found = sums.groupBy(*keys).agg(F.first("_n").alias("_n"), *[pick(r).alias(f"_l{k}") for k, r in enumerate(low)], *[pick(r).alias(f"_h{k}") for k, r in enumerate(high)])

    def value(k: int, p: float) -> Column:
        share = (F.col("_n") - 1) * F.lit(float(p))
        return F.col(f"_l{k}") + (share - F.floor(share)) * (F.col(f"_h{k}") - F.col(f"_l{k}"))

    found = found.select(*keys, "_n", F.array(*[value(k, p) for k, p in enumerate(probs)]).alias("_q"))
    every = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")).select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)])
    joined = _matched(every, found, keys, "left") if by else found.groupBy().agg(F.first("_n").alias("_n"), F.first("_q").alias("_q"))
    return joined.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], F.coalesce("_n", F.lit(0)).alias("n"), F.col("_q").alias(out))


def _matched(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with b's other columns where the keys are the same, nulls included."""
    other = b.select(*[F.col(c).alias(f"_k{c}") for c in keys], *[c for c in b.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in keys])
    return a.join(other, on, how).drop(*[f"_k{c}" for c in keys])
