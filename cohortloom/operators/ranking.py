"""Ranks, multiplicity adjustments, ordered selections and tail counts.

Groups of rows may be of any size: their ranks and running sums are made in two
levels, so that no task has a whole group, unless most of its rows have one value and
their order within it is asked for. A family's correction ranks its distinct p in the
same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.columns import required
from cohortloom.sources.workspace import shared_folder


BUCKETS = 1024
#: Slices of each doubling of a value's size.
SLICES = 256


def _bucketed(df: DataFrame, by: list[str], x: str, few: bool = False) -> DataFrame:
    """df with _bucket, a long that doesn't fall as x grows within a group, nulls first.

    It is the place of x among BUCKETS equal steps from its group's smallest to its
    largest value, and within a step its place among the SLICES of each doubling: a
    single extreme value leaves the steps empty but not the slices, and values of
    nearly one size share slices but not steps. Both only grow with x, so a group has
    at most as many buckets as steps and slices together. Bounds are exact, so that a
    plan that is run twice deals its rows alike. Rows of one value share a bucket. few: groups are of a bounded number,
    such as draws, so that their bounds go to the rows.
    """
    bounds = df.groupBy(*[F.col(c).alias(f"_b_{c}") for c in by]).agg(F.min(x).cast("double").alias("_low"), F.max(x).cast("double").alias("_high"))
    on = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]
    joined = df.join(F.broadcast(bounds) if few else bounds, on) if by else df.crossJoin(bounds)
    v = F.col(x).cast("double")
    step = (v - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    bucket = F.coalesce(F.least(F.floor(step * BUCKETS), F.lit(BUCKETS - 1)).cast("long"), F.lit(0))
    # doubles lie between 2 ** -1074 and 2 ** 1024
    size = F.floor(F.log2(F.abs(v)) * SLICES).cast("long") + 1100 * SLICES
    slice_ = F.when((v == 0) | F.isnan(v) | (F.abs(v) == float("inf")), 0).when(v < 0, -size).otherwise(size)
    return joined.withColumn("_bucket", F.when(F.col(x).isNull(), -1).otherwise(bucket * (1 << 21) + slice_ + (1 << 20))).drop("_low", "_high", *[f"_b_{c}" for c in by])


def running_sums(df: DataFrame, by: list[str], x: str, sums: dict[str, str]) -> DataFrame:
    """df, one row for each x of a group, with the sum over smaller x of each named column.

    Two levels: within a bucket of x, and over the buckets' totals; no task has a whole group.
    """
    placed = _bucketed(df, by, x)
    totals = placed.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_bucket").alias("_at"), *[F.coalesce(F.sum(f"_t_{o}").over(upto), F.lit(0)).alias(f"_s_{o}") for o in sums])
    inside = Window.partitionBy(*by, "_bucket").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    on = [F.col("_bucket") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]]
    out = placed.join(before, on).withColumns({o: F.col(f"_s_{o}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in sums.items()})
    return out.select(*df.columns, *sums)


def numbered(df: DataFrame, by: list[str], x: str, rest: list[str], out: str = "row_number") -> DataFrame:
    """df with each row's number from 1 in its group in the order of x and rest, in two levels as running_sums()."""
    placed = _bucketed(df, by, x)
    totals = placed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_s"))
    on = [F.col("_bucket") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]]
    inside = Window.partitionBy(*by, "_bucket").orderBy(x, *rest)
    return placed.join(before, on).withColumn(out, F.col("_s") + F.row_number().over(inside)).select(*df.columns, out)


def rank_table(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """by, x, rank (ties share their mean rank), n for each distinct value: built from counts, so that repeated values are combined map-side."""
    counts = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(counts, by, x, {"_before": "n"}).select(*by, x, (F.col("_before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"), "n")


def average_ranks(df: DataFrame, x: str, by: list[str], out: str = "rank") -> DataFrame:
    """df with each row's rank in its group, ties sharing their mean rank."""
    ranks = rank_table(df, x, by).select(*[F.col(c).alias(f"_r_{c}") for c in (*by, x)], F.col("rank").alias(out))
    return df.join(ranks, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in (*by, x)]).select(*df.columns, out)


def _probabilities(df: DataFrame, p: str) -> DataFrame:
    """df, whose p must all lie between 0 and 1: a family with a gap can't be corrected."""
    return df.withColumn(p, required(F.coalesce(F.col(p).between(0.0, 1.0), F.lit(False)), F.col(p), f"{p} must lie between 0 and 1"))


def running_extreme(df: DataFrame, by: list[str], x: str, value: str, out: str, largest: bool) -> DataFrame:
    """df, one row for each x of a group, with the largest value of all x up to its own (largest), or the smallest from its own on.

    In two levels as running_sums().
    """
    placed = _bucketed(df, by, x)
    best, order = (F.max, F.col("_bucket").asc()) if largest else (F.min, F.col("_bucket").desc())
    totals = placed.groupBy(*by, "_bucket").agg(best(value).alias("_best"))
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_bucket").alias("_at"), best("_best").over(upto).alias("_so_far"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.col(x).asc() if largest else F.col(x).desc()).rowsBetween(Window.unboundedPreceding, 0)
    on = [F.col("_bucket") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]]
    pick = F.greatest if largest else F.least  # both pass over nulls
    return placed.join(before, on).withColumn(out, pick(F.col("_so_far"), best(value).over(inside))).select(*df.columns, out)


def _adjusted(df: DataFrame, p: str, family: list[str], out: str, value, largest: bool) -> DataFrame:
    """df with the adjusted p of its family: rows of one p share it, so that only distinct p are ranked, however many rows have one."""
    df = _probabilities(df, p)
    # ranks refer to the counts many times over: they are written, so that plans of corrections upon corrections stay small
    counts, folder = df.groupBy(*family, p).agg(F.count(F.lit(1)).alias("_n")), shared_folder(df.sparkSession, "families")
    counts.write.parquet(folder)
    counts = df.sparkSession.read.schema(counts.schema).parquet(folder)
    whole = counts.groupBy(*[F.col(c).alias(f"_w_{c}") for c in family]).agg(F.sum("_n").alias("_m"))
    ranked = running_sums(counts, family, p, {"_before": "_n"})
    ranked = ranked.join(whole, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in family]) if family else ranked.crossJoin(whole)
    ranked = running_extreme(ranked.select(*family, p, F.least(F.lit(1.0), value(F.col(p))).alias("_v")), family, p, "_v", "_q", largest)
    other = ranked.select(*[F.col(c).alias(f"_q_{c}") for c in (*family, p)], F.col("_q").alias(out))
    return df.join(other, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in (*family, p)]).drop(*[f"_q_{c}" for c in (*family, p)])


def benjamini_hochberg(df: DataFrame, p: str, family: list[str], tie: list[str] | None = None, out: str = "q") -> DataFrame:
    """Step-up adjusted p: from the largest on, the smallest of p x m / rank so far, at most 1. Equal p have one adjusted p, whatever order `tie` gives them."""
    return _adjusted(df, p, family, out, lambda x: x * F.col("_m") / (F.col("_before") + F.col("_n")), False)


def holm(df: DataFrame, p: str, family: list[str], tie: list[str] | None = None, out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p: the largest of p x (m - rank + 1), at most 1, so far. Equal p have one adjusted p, whatever order `tie` gives them."""
    return _adjusted(df, p, family, out, lambda x: x * (F.col("_m") - F.col("_before")), True)


def roc_points(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """by, threshold, tpr, fpr, area: rates at each distinct threshold, and its step's share of the area."""
    steps = df.groupBy(*by, p).agg(F.sum((F.col(y) == 1).cast("long")).alias("_t"), F.sum((F.col(y) == 0).cast("long")).alias("_f"))
    steps = steps.withColumn("_down", -F.col(p))
    sums = running_sums(steps, by, "_down", {"_tb": "_t", "_fb": "_f"})
    whole = df.groupBy(*[F.col(c).alias(f"_w_{c}") for c in by]).agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg"))
    out = sums.join(F.broadcast(whole) if not by else whole, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in by]) if by else sums.crossJoin(F.broadcast(whole))
    pos, neg = F.nullif(F.col("_pos"), F.lit(0)), F.nullif(F.col("_neg"), F.lit(0))
    tpr, fpr = (F.col("_tb") + F.col("_t")) / pos, (F.col("_fb") + F.col("_f")) / neg
    area = F.col("_f") / neg * (tpr + F.col("_tb") / pos) / 2
    return out.select(*by, F.col(p).alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), area.alias("area"))


def tolerant_minimum(df: DataFrame, value: str, by: list[str], order: list[str], slack: float = 1e-8) -> DataFrame:
    """Of the rows within slack of their group's minimum, the first in the given order."""
    best = df.groupBy(*[F.col(c).alias(f"_m_{c}") for c in by]).agg(F.min(value).alias("_best"))
    near = df.join(best, [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in by]).where(F.col(value) <= F.col("_best") + slack)
    first = near.groupBy(*by).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def largest_absolute(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """The row with the largest absolute value of each group, ties by name."""
    first = df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), F.struct((-F.abs(F.col(value))).alias("v"), F.col(name).alias("n"))).alias("_row"))
    return first.select("_row.*")


def tail_p(null: Column, observed: Column, slack: float = 1e-12) -> Column:
    """Aggregate: two-sided tail probability with one added to both counts; near ties count."""
    return (F.lit(1.0) + F.count_if(F.abs(null) >= F.abs(observed) - slack)) / (F.count(null) + 1)


def centred_tail_p(null: Column, mean: Column, observed: Column, slack: float = 1e-12) -> Column:
    """Aggregate: the same of deviations from the null's mean."""
    return tail_p(null - mean, observed - mean, slack)
