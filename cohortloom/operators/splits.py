"""Cross-validation plans as tables, their audits, and preprocessing inside a fold.

A plan is (repeat, fold, inner_fold, role, row_pos): role is train or test for
the outer split (inner_fold null) and inner_train or validation for inner ones.
Saved plans are the contract; stratified() makes new ones by a rule of its own:
rows of a class in the order of a hash of (seed, repeat, row_pos) take folds in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import required
from cohortloom.operators.quantiles import quantiles
from cohortloom.operators.ranking import numbered
from cohortloom.sources.workspace import written


def fold_count(df: DataFrame, y: str) -> DataFrame:
    """One row: class sizes and the largest of 5, 4, 3 folds that leaves 2 of the smaller class in each test part and 3 in training; null if none does."""
    sizes = df.agg(F.count_if(F.col(y) == 0).alias("zeros"), F.count_if(F.col(y) == 1).alias("ones"))
    m = F.least("zeros", "ones")
    fits = lambda k: (F.floor(m / k) >= 2) & (m - F.ceil(m / k) >= 3)
    return sizes.withColumn("folds", F.when(fits(5), 5).when(fits(4), 4).when(fits(3), 3))


def dealt(df: DataFrame, strata: list[str], order: Column, tie: str, folds: int, out: str = "fold") -> DataFrame:
    """df with fold numbers dealt in turn to the rows of each stratum in the order of a number, ties by another column."""
    rows = numbered(df.withColumn("_order", order), strata, "_order", [tie], "_k")
    return rows.withColumn(out, (F.col("_k") - 1) % folds).drop("_order", "_k")


def stratified(df: DataFrame, y: str, folds: int, repeats: int, seed: int, row: str = "row_pos") -> DataFrame:
    """repeat, row, y, fold: every row is tested once in each repeat."""
    out = df.select(row, y, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    return dealt(out, ["repeat", y], F.xxhash64(F.lit(seed), "repeat", row), row, folds)


def nested(outer: DataFrame, y: str, inner_folds: int, seed: int, row: str = "row_pos") -> DataFrame:
    """The whole plan of outer (repeat, row, y, fold): roles of every row in every outer and inner split. outer is written once, as its rows are read for each part."""
    outer = written(outer.select("repeat", row, y, "fold"), "outer")
    folds = outer.groupBy("repeat").agg((F.max("fold") + 1).alias("_n"))
    every = outer.join(folds, "repeat").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    rows = every.select("repeat", F.col("_k").alias("fold"), F.lit(None).cast("int").alias("inner_fold"), F.when(F.col("fold") == F.col("_k"), "test").otherwise("train").alias("role"), row, y)
    inner = dealt(rows.where("role = 'train'"), ["repeat", "fold", y], F.xxhash64(F.lit(seed), "repeat", "fold", row), row, inner_folds, "_i")
    inner = inner.withColumn("inner_fold", F.explode(F.sequence(F.lit(0), F.lit(inner_folds - 1)))).select("repeat", "fold", "inner_fold", F.when(F.col("_i") == F.col("inner_fold"), "validation").otherwise("inner_train").alias("role"), row, y)
    return rows.unionByName(inner)


def grouped(df: DataFrame, group: str, y: str, folds: int) -> DataFrame:
    """group, y, fold of each distinct group: copies of a person share a fold."""
    people = df.groupBy(group).agg(F.max(y).alias(y))
    return dealt(people, [y], F.col(group), group, folds)


def joint_inner(outer: DataFrame, scanner: DataFrame, y: str, inner_folds: int, seed: int, fewest: int = 3, row: str = "row_pos") -> DataFrame:
    """nested() with inner folds dealt within each cell of scanner and outcome; a training cell of fewer than `fewest` rows fails.

    scanner: row, scanner (0 or 1). The outer folds are as they are.
    """
    joint = outer.join(scanner.select(row, "scanner"), row).withColumn("_cell", 2 * F.col("scanner").cast("int") + F.col(y).cast("int"))
    plan = nested(joint.select("repeat", row, "fold", F.col("_cell").alias("_y")), "_y", inner_folds, seed, row)
    cells = plan.where("role = 'train'").groupBy("repeat", "fold", "_y").agg(F.count(F.lit(1)).alias("_n"))
    least = cells.groupBy("repeat", "fold").agg(F.min("_n").alias("_least"), F.count(F.lit(1)).alias("_cells"))
    ok = (F.col("_least") >= fewest) & (F.col("_cells") == 4)
    checked = plan.join(least, ["repeat", "fold"]).withColumn("fold", required(ok, F.col("fold"), f"a cell of scanner and outcome has fewer than {fewest} training rows"))
    return checked.select("repeat", "fold", "inner_fold", "role", row, (F.col("_y") % 2).alias(y))


def coverage(plan: DataFrame, rows: DataFrame, row: str = "row_pos") -> DataFrame:
    """repeat, n_rows, tested_once, others: how many rows are tested exactly once in each repeat."""
    n = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    tested = plan.groupBy("repeat", row).agg(F.count(F.lit(1)).alias("c"))
    return tested.groupBy("repeat").agg(F.count_if(F.col("c") == 1).alias("tested_once"), F.count_if(F.col("c") != 1).alias("others")).crossJoin(F.broadcast(n))


def plan_faults(plan: DataFrame, y: str = "y", row: str = "row_pos") -> DataFrame:
    """One row: rows with two outer roles in a split, inner rows that aren't outer training rows, inner rows not validated exactly once, inner parts with one class."""
    outer = plan.where("inner_fold is null").groupBy("repeat", "fold", row).agg(F.count(F.lit(1)).alias("c"), F.max((F.col("role") == "train").cast("int")).alias("t"))
    inner = plan.where("inner_fold is not null")
    by_row = inner.groupBy("repeat", "fold", row).agg(F.count_if(F.col("role") == "validation").alias("v"))
    joined = by_row.join(outer, ["repeat", "fold", row], "full")
    rows_ = joined.agg(F.count_if(F.col("c") != 1).alias("double_roles"), F.count_if(F.col("v").isNotNull() & (F.coalesce("t", F.lit(0)) == 0)).alias("leaks"), F.count_if((F.col("t") == 1) & (F.coalesce("v", F.lit(0)) != 1)).alias("not_once"))
    parts = inner.groupBy("repeat", "fold", "inner_fold", "role").agg(F.count_distinct(y).alias("k")).agg(F.count_if(F.col("k") < 2).alias("one_class"))
    return rows_.crossJoin(parts)


def isolation_faults(fitted: DataFrame, plan: DataFrame, row: str = "row_pos") -> DataFrame:
    """One row: rows that a fit used against the plan, and planned rows that it didn't use. Both: repeat, fold, row."""
    keys = ["repeat", "fold", row]
    sides = fitted.select(*keys, F.lit(1).alias("b")).unionByName(plan.select(*keys, F.lit(2).alias("b"))).groupBy(*keys).agg(F.bit_or("b").alias("b"))
    return sides.agg(F.count_if(F.col("b") == 1).alias("unplanned"), F.count_if(F.col("b") == 2).alias("unused"))


def fold_state(train: DataFrame, by: list[str], numeric: list[str]) -> DataFrame:
    """by, field, fill (median), mean, scale, dropped: moments are of filled values, deviation divides by n, 0 becomes 1; a column of one value is dropped."""
    long = train.select(*by, F.explode(F.create_map(*[x for c in numeric for x in (F.lit(c), F.col(c).cast("double"))]))).toDF(*by, "field", "v")
    fill = quantiles(long, "v", [*by, "field"], [0.5], "_q").select(*by, "field", F.col("_q")[0].alias("fill"))
    filled = long.join(fill, [*by, "field"]).withColumn("x", F.coalesce("v", "fill"))
    sd = F.stddev_pop("x")
    return filled.groupBy(*by, "field").agg(F.first("fill").alias("fill"), F.avg("x").alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("scale"), (F.max("x") == F.min("x")).alias("dropped"))


def fold_mode(train: DataFrame, by: list[str], column: str, levels: list[str]) -> DataFrame:
    """by, fill: the most frequent level, ties by the order of levels (reference first)."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column))
    counts = train.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("fill"), place.alias("_o")).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*by).agg(F.max_by("fill", F.struct("_c", -F.col("_o"))).alias("fill"))


def cell_counts(df: DataFrame, by: list[str], scanner: str, y: str) -> DataFrame:
    """by, scanner, y, n with empty cells as 0."""
    counts = df.groupBy(*by, scanner, y).agg(F.count(F.lit(1)).alias("n"))
    every = df.select(*by, scanner).distinct().withColumn(y, F.explode(F.array(F.lit(0), F.lit(1))))
    return every.join(counts.withColumn(y, F.col(y).cast("int")), [*by, scanner, y], "left").withColumn("n", F.coalesce("n", F.lit(0)))
