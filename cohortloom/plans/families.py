"""Complete families of regional tests as tables: every declared test is a group, and correction always counts all of them."""

from __future__ import annotations

import inspect
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.assembly import standardized
from cohortloom.operators.contracts import ContractError
from cohortloom.operators.least_squares import associations
from cohortloom.operators.ranking import benjamini_hochberg
from cohortloom.sources.workspace import written

#: Processing variants, the original first, and those that predictions are made from.
VARIANTS = ("original", "wholeBrain", "cerebellarCortex", "petprep", "same_seg_noPVC", "PVC4", "PVC5.4", "PVC6")
CLINICAL = ("age", "male", "duration", "log_frequency", "lesional")


def design_table(cohort: DataFrame, continuous: list[str], t1: list[str]) -> DataFrame:
    """cohort with z_<column> of continuous covariates and structural measures, over all complete rows, divisor n - 1."""
    return standardized(cohort, [*continuous, *t1])


def tests(long: DataFrame, cohort: DataFrame, adjustments: dict[str, list[str]], matched: dict[str, str] | None = None, with_influence: bool = False) -> DataFrame:
    """variant, region, adjustment and association columns of every variant x region x adjustment.

    long: study_id, variant, region, value; cohort: study_id, y and covariates; matched: region to the cohort column
    that an adjustment naming "matched" adds for that region.
    """
    rows = long.join(cohort, "study_id")
    if matched:
        pairs = F.create_map(*[x for r, c in matched.items() for x in (F.lit(r), F.col(c))])
        rows = rows.withColumn("matched", pairs[F.col("region")])
    parts = [associations(rows.withColumn("adjustment", F.lit(name)), ["variant", "region", "adjustment"], "value", "y", covariates, with_influence) for name, covariates in adjustments.items()]
    return reduce(DataFrame.unionByName, parts)


def corrected(rows: DataFrame, count: int, out: str = "q_family") -> DataFrame:
    """rows with the family's adjusted p; another number of rows than declared fails."""
    # a family's fits are made once: its correction and all that follows read their table
    rows = written(rows, "family")
    n = rows.count()
    if n != count:
        raise ContractError(f"{n} tests of a family of {count}")
    keyed = rows.withColumn("_f", F.lit(1))
    return benjamini_hochberg(keyed, "p", ["_f"], ["variant", "region", "adjustment"], out).drop("_f").withColumn("family_tests", F.lit(count))


def morphometric_family(long: DataFrame, cohort: DataFrame, matched: dict[str, str], clinical: list[str], scanner: str) -> DataFrame:
    """Twelve tests: six regions by clinical covariates alone, and with scanner and the region's structural measure."""
    return corrected(tests(long.where("variant = 'original'"), cohort, {"clinical": clinical, "clinical_scanner_t1": [*clinical, scanner, "matched"]}, matched), 12)


def extended_family(long: DataFrame, cohort: DataFrame, types: list[str], etiologies: list[str], clinical: list[str], scanner: str) -> DataFrame:
    """Eighteen tests: six regions by seizure type, etiology, and both."""
    base = [*clinical, scanner]
    return corrected(tests(long.where("variant = 'original'"), cohort, {"type": [*base, *types], "etiology": [*base, *etiologies], "type_etiology": [*base, *types, *etiologies]}), 18)


def processing_family(long: DataFrame, cohort: DataFrame, matched: dict[str, str], clinical: list[str], scanner: str, with_influence: bool = True) -> DataFrame:
    """Ninety-six tests: eight variants, six regions, two adjustments."""
    found = {r[0] for r in long.select("variant").distinct().limit(20).collect()}
    if found != set(VARIANTS):
        raise ContractError(f"variants {sorted(found ^ set(VARIANTS))} are missing or unknown")
    base = [*clinical, scanner]
    return corrected(tests(long, cohort, {"base": base, "base_t1": [*base, "matched"]}, matched, with_influence), 96)


def followup_families(extended: DataFrame, processing: DataFrame) -> DataFrame:
    """The 18 and 96 rows with their own adjusted p and, beside it, that of all 114."""
    both = extended.withColumn("family", F.lit("clinical")).unionByName(processing.withColumn("family", F.lit("processing")), allowMissingColumns=True)
    return corrected(both.drop("family_tests"), 114, "q_all114")


def factor_test(df: DataFrame, by: list[str], value: str, covariates: list[str], levels: list[str]) -> DataFrame:
    """by, F, p, partial_r2, means and differences (arrays of structs) of a factor coded by 0/1 columns."""
    from cohortloom.operators import linear

    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes if c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[[*covariates, *levels]].to_numpy(float)
        a = pd.DataFrame(a).assign(one=1.0)[["one", *range(a.shape[1])]].to_numpy()
        at = list(range(1 + len(covariates), a.shape[1]))
        f, m = linear.joint_f(a, pdf[value].to_numpy(float), at), linear.adjusted_means(a, pdf[value].to_numpy(float), at)
        names = ["reference", *levels]
        out = {"F": f["F"], "p": f["p"], "partial_r2": f["partial_r2"], "means": [{"level": n, "mean": x, "lo": lo, "hi": hi} for n, (x, lo, hi) in zip(names, m["means"])], "differences": [{"contrast": f"{names[i]} - {names[j]}", "difference": x, "lo": lo, "hi": hi} for (i, j), (x, lo, hi) in m["differences"].items()]}
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, **out}])

    return df.groupBy(*by).applyInPandas(run, f"{schema}, F double, p double, partial_r2 double, means array<struct<level:string,mean:double,lo:double,hi:double>>, differences array<struct<contrast:string,difference:double,lo:double,hi:double>>")


def processing_models(column_sets: dict[str, list[str]], variants: tuple[str, ...] = VARIANTS[1:]) -> list[tuple[str, str, str, list[str]]]:
    """(name, variant, model, columns) of every variant's CP and CPT model."""
    return [(f"{v}_{m}", v, m, column_sets[m]) for v in variants for m in ("CP", "CPT")]


def processing_comparisons(variants: tuple[str, ...] = VARIANTS[1:], core: str = "CORE", matched: str = "same_seg_noPVC") -> list[tuple[str, str]]:
    """Pairs (a, b) to be compared as a - b: the first four variants with the core and the matched variant, and CP with C, CPT with CP, for all."""
    first = [(f"{v}_{m}", b) for v in variants[:4] for m in ("CP", "CPT") for b in (f"{core}_{m}", *((f"{matched}_{m}",) if v != matched else ()))]
    return first + [p for v in variants for p in ((f"{v}_CP", f"{core}_C"), (f"{v}_CPT", f"{v}_CP"))]


#: The families by name; each takes the arguments of its function.
FAMILIES = {"morphometric": morphometric_family, "extended": extended_family, "processing": processing_family}


def run_family(name: str, long: DataFrame, cohort: DataFrame, **arguments) -> DataFrame:
    """The named family's rows; an unknown name, or arguments that the family doesn't have, fail before any fit."""
    if name not in FAMILIES:
        raise ContractError(f"no family {name!r}; known: {sorted(FAMILIES)}")
    try:
        inspect.signature(FAMILIES[name]).bind(long, cohort, **arguments)
    except TypeError as e:
        raise ContractError(f"{name}: {e}") from e
    return FAMILIES[name](long, cohort, **arguments)
