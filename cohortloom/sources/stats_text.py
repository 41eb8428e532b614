"""Parsers of whitespace-separated measurement texts, as column expressions on lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import finite, required


def fields(line: Column) -> Column:
    """Tokens of a line; none for comments and blank lines."""
    return F.when(F.trim(line).startswith("#") | (F.trim(line) == ""), F.array().cast("array<string>")).otherwise(F.split(F.trim(line), r"\s+"))


def intracranial_volume(line: Column) -> Column:
    """The value of a `# Measure EstimatedTotalIntraCranialVol, ...` header line, else null."""
    return F.nullif(F.regexp_extract(line, r"^#\s*Measure\s+EstimatedTotalIntraCranialVol,.*?,.*?,\s*([0-9.eE+-]+)\s*,", 1), F.lit("")).try_cast("double")


def structure_volumes(lines: DataFrame) -> DataFrame:
    """subject, structure, volume of lines (subject, line) with five fields or more: name fifth, volume fourth; others are skipped."""
    f = F.col("_f")
    return lines.select("subject", fields(F.col("line")).alias("_f")).where(F.size("_f") >= 5).select("subject", f[4].alias("structure"), f[3].try_cast("double").alias("volume")).where("volume is not null")


def parcel_thickness(lines: DataFrame) -> DataFrame:
    """subject, hemi, parcel, area, thickness of lines with five fields or more: name first, area third, thickness fifth; others are skipped."""
    f = F.col("_f")
    out = lines.select("subject", "hemi", fields(F.col("line")).alias("_f")).where(F.size("_f") >= 5)
    return out.select("subject", "hemi", f[0].alias("parcel"), f[2].try_cast("double").alias("area"), f[4].try_cast("double").alias("thickness")).where("area is not null and thickness is not null")


def gtm_table(lines: DataFrame) -> DataFrame:
    """subject, label, value of lines of exactly eight fields: label second, value seventh; any other line that isn't blank, and a non-finite value, fails."""
    f = F.col("_f")
    rows = lines.select("subject", fields(F.col("line")).alias("_f")).where(F.size("_f") > 0)
    value = f[6].cast("double")
    return rows.select("subject", required(F.size("_f") == 8, f[1].cast("int"), "a line hasn't eight fields").alias("label"), required(finite(value), value, "a value isn't finite").alias("value"))


def transform_matrix(text: Column) -> tuple[Column, Column]:
    """(type, 4 x 4 matrix as array of rows) of a linear-transform text: one type line and one `1 4 4` block, else the query fails."""
    kind = F.regexp_extract_all(text, F.lit(r"(?m)^type\s*=\s*(\d+)"), F.lit(1))
    number = r"[-+0-9.eE]+"
    block = F.regexp_extract_all(text, F.lit(rf"(?m)^1 4 4\s*\n((?:\s*{number}\s+{number}\s+{number}\s+{number}\s*\n){{4}})"), F.lit(1))
    rows = F.transform(F.filter(F.split(block[0], "\n"), lambda r: F.trim(r) != ""), lambda r: F.split(F.trim(r), r"\s+").cast("array<double>"))
    return required(F.size(kind) == 1, kind[0].cast("int"), "the transform hasn't one type"), required(F.size(block) == 1, rows, "the transform hasn't one 4 x 4 matrix")
