"""Data contracts: each is one aggregation of violation counts, which raises or reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import finite


class ContractError(ValueError):
    """Data that break a contract; never repaired, never dropped."""


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row: n_rows and, for each named rule, in how many rows it holds."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])


def require(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """df, if no rule holds anywhere; else ContractError names the rules and their counts."""
    row = violations(df, rules).first().asDict()
    broken = {k: n for k, n in row.items() if k != "n_rows" and n}
    if broken:
        raise ContractError(", ".join(f"{k}: {n} rows" for k, n in broken.items()))
    return df


def key_rules(df: DataFrame, key: str, pattern: str = "^[A-Za-z0-9]+$") -> DataFrame:
    """One row: null, malformed and repeated keys. Repeats are counted after a map-side count by key."""
    by_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"), F.count_if(~F.col(key).cast("string").rlike(pattern)).alias("malformed_keys"), F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("repeated_keys"))


def input_rules(numeric: Iterable[str], categories: Mapping[str, Iterable], outcome: str) -> dict[str, Column]:
    """Rules of a model input: outcomes of 0 or 1, numbers that aren't infinite, known categories."""
    y = F.col(outcome).cast("double")
    rules = {"bad_outcome": y.isNull() | ~y.isin(0.0, 1.0)}
    rules |= {f"infinite_{c}": F.abs(F.col(c).cast("double")) == float("inf") for c in numeric}
    return rules | {f"unknown_{c}": F.col(c).isNotNull() & ~F.col(c).isin(list(levels)) for c, levels in categories.items()}


def missing_shares(df: DataFrame, columns: Iterable[str], at_most: float = 0.2) -> DataFrame:
    """column, share (of nulls and NaN), rejected: a row for each column, from one pass."""
    columns = list(columns)
    absent = lambda c: F.col(c).isNull() | (F.isnan(F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))
    wide = df.agg(*[F.avg(absent(c).cast("double")).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "share").withColumn("rejected", F.col("share") > at_most)


def closed_columns(df: DataFrame, allowed: Iterable[str], needed: Iterable[str] = ()) -> DataFrame:
    """df, if it has no column beyond allowed and all that are needed: a check of the schema alone."""
    extra, lacking = set(df.columns) - set(allowed), set(needed) - set(df.columns)
    if extra or lacking:
        raise ContractError(f"unexpected columns {sorted(extra)}, missing columns {sorted(lacking)}")
    return df


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys of each side that the other lacks, from one shuffle of both."""
    sides = left.select(key, F.lit(1).alias("bit")).unionByName(right.select(key, F.lit(2).alias("bit")))
    seen = sides.groupBy(key).agg(F.bit_or("bit").alias("bits"))
    return seen.agg(F.count_if(F.col("bits") == 1).alias("only_left"), F.count_if(F.col("bits") == 2).alias("only_right"), F.count_if(F.col("bits") == 3).alias("both"))


def largest_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the largest absolute difference, and how often just one side is null."""
    return df.agg(F.max(F.abs(F.col(a) - F.col(b))).alias("largest"), F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias("one_sided"))


def complete_family(df: DataFrame, keys: list[str], tests: int) -> DataFrame:
    """One row: rows, distinct keys and whether they are the declared number of tests."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*[F.col(k) for k in keys]).alias("n_keys")).withColumn("complete", (F.col("n_rows") == tests) & (F.col("n_keys") == tests))


def predictions_rules(df: DataFrame, ids: DataFrame, repeats: int) -> DataFrame:
    """For each model of (model, repeat, row_pos, p): cells, bad probabilities, and whether each of ids has one cell a repeat."""
    n = ids.agg(F.count(F.lit(1)).alias("n_ids"))
    cells = df.groupBy("model").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("repeat", "row_pos").alias("distinct_cells"), F.count_if(~finite(F.col("p")) | ~F.col("p").between(0, 1)).alias("bad_p"))
    return cells.join(F.broadcast(n)).withColumn("complete", (F.col("cells") == F.col("n_ids") * repeats) & (F.col("distinct_cells") == F.col("cells")) & (F.col("bad_p") == 0)).drop("n_ids")


def parcel_rules(parcels: DataFrame) -> DataFrame:
    """One row of an atlas (parcel_pos, hemi, homologue_pos): size, order and homologue faults."""
    other = parcels.select(F.col("parcel_pos").alias("homologue_pos"), F.col("hemi").alias("h2"), F.col("homologue_pos").alias("back"))
    paired = parcels.join(other, "homologue_pos", "left")
    return paired.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hemi") == "R").alias("n_right"), F.count_if(F.col("h2").isNull() | (F.col("h2") == F.col("hemi")) | (F.col("back") != F.col("parcel_pos"))).alias("bad_homologues"), F.count_if((F.col("hemi") == "R") & (F.col("parcel_pos") >= 34) | (F.col("hemi") == "L") & (F.col("parcel_pos") < 34)).alias("out_of_order"))
