"""Keyed assembly: alignment in cohort order, projections and encodings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import required, within


def align(cohort: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The cohort with the table's columns; a key that the table lacks fails the query, extra keys of the table are ignored.

    The check is part of the plan: no second pass over either side.
    """
    found = table.select(key, *columns, F.lit(True).alias("_found"))
    out = cohort.join(found, key, "left")
    first, *rest = columns
    checked = required(F.coalesce(F.col("_found"), F.lit(False)), F.col(first), f"a cohort key is missing from the table that has {first}")
    return out.withColumn(first, checked).select(*cohort.columns, first, *rest)


def assemble(cohort: DataFrame, key: str, tables: Mapping[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """The cohort aligned with each named table's columns, one equi-join after the other."""
    for table, columns in tables.values():
        cohort = align(cohort, table, key, columns)
    return cohort


def missing_keys(cohort: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of the cohort that the table has no key for; also the rows out of a bag of drawn rows."""
    return cohort.join(table.select(key), key, "left_anti")


def members(table: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return table.join(allowed.select(key), key, "left_semi")


def swap_columns(base: DataFrame, variant: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the named columns taken from variant, in base's column order; keys must match."""
    return align(base.drop(*columns), variant, key, columns).select(*base.columns)


def reference_dummies(levels: Mapping[str, list]) -> list[Column]:
    """0/1 columns for all but the first (reference) level of each category; unknown and null values fail."""
    out = []
    for c, (reference, *others) in levels.items():
        known = F.coalesce(F.col(c).isin([reference, *others]), F.lit(False))
        out += [required(known, (F.col(c) == v).cast("double"), f"{c} has an unknown level").alias(f"{c}_{v}") for v in others]
    return out


def standardized(df: DataFrame, columns: list[str], sample: bool = True, by: list[str] | None = None) -> DataFrame:
    """df with z_<column> over all its rows or within groups; divides by n - 1 (sample) or n.

    One aggregation, whose rows are joined back: no window has a whole group.
    """
    by = by or []
    moments = df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[(F.stddev_samp if sample else F.stddev_pop)(c).alias(f"_s_{c}") for c in columns])
    out = df.join(moments, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]) if by else df.crossJoin(F.broadcast(moments))
    return out.select(*df.columns, *[((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))).alias(f"z_{c}") for c in columns])


def log_frequency(raw: str, supplied: str | None = None) -> Column:
    """ln(1 + raw); a supplied version is kept if it agrees within 1e-12 and is missing where raw is, else the query fails."""
    derived = F.log1p(F.col(raw).cast("double"))
    return derived if supplied is None else required(within(derived, F.col(supplied)), F.col(supplied), f"{supplied} isn't ln(1 + {raw})")


def gather(values: DataFrame, crosswalk: DataFrame, position: str) -> DataFrame:
    """Rows of values picked by a crosswalk (to_pos, position); a position that doesn't exist fails."""
    picked = crosswalk.join(values.withColumn("_there", F.lit(True)), position, "left")
    return picked.withColumn("to_pos", required(F.coalesce("_there", F.lit(False)), F.col("to_pos"), "the crosswalk names a position that isn't there")).drop("_there")
