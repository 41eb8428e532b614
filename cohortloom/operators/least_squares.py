"""Least squares with HC3 inference and influence for many groups at once, of any size.

Three aggregations over the rows and no grouped kernel: (1) each group's means and
deviations, (2) products of its standardized columns, (3) with the inverse of those
products joined back, leverages, residuals and the sandwich. A row's leverage is
1/n + z'Gz and the coefficients without it are b - Gz e / (1 - h), so that
leave-one-out refits cost nothing more. What is joined back has a row a group;
only such rows, of p x p figures, meet NumPy.

Groups that can't be fitted have a status and null figures: `rank` (rows no more
than columns, a value that isn't finite, columns that depend on each other),
`leverage` (a row that alone fixes a coefficient), `deviation` (no spread within
the response's groups).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import finite
from cohortloom.functions.distributions import t_quantile, t_two_sided

#: Smallest share of a correlation matrix's trace that its smallest eigenvalue may have.
RANK = 1e-11
LEVERAGE = 1 - 1e-8
OK = "ok"


def _back(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of its group's row; null keys meet null keys."""
    keyed = groups.select(*[F.col(c).alias(f"_k_{c}") for c in by], *[c for c in groups.columns if c not in by])
    if not by:
        return df.crossJoin(F.broadcast(keyed))
    return df.join(keyed, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]).drop(*[f"_k_{c}" for c in by])


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def standardized_rows(df: DataFrame, by: list[str], value: str, columns: list[str], keep: list[str]) -> DataFrame:
    """by, keep, _z0.. (columns less their group's mean, over their deviation; 0 without spread), _w (value less its mean), _s (deviations), _n, _bad (rows with a value that isn't finite)."""
    x = [F.col(c).cast("double") for c in columns]
    v = F.col(value).cast("double")
    good = reduce(lambda a, b: a & b, [finite(c) for c in (*x, v)])
    base = df.select(*by, *keep, *[c.alias(f"_x{j}") for j, c in enumerate(x)], v.alias("_v"), (~good).alias("_odd"))
    cells = [f(f"_x{j}").alias(f"_{n}{j}") for j in range(len(x)) for n, f in (("m", F.avg), ("d", F.stddev_pop))]
    moments = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_odd").alias("_bad"), F.avg("_v").alias("_mv"), *cells)
    rows = _back(base, moments, by)
    z = [F.coalesce((F.col(f"_x{j}") - F.col(f"_m{j}")) / F.nullif(F.col(f"_d{j}"), F.lit(0.0)), F.lit(0.0)).alias(f"_z{j}") for j in range(len(x))]
    return rows.select(*by, *keep, *z, (F.col("_v") - F.col("_mv")).alias("_w"), F.array(*[F.col(f"_d{j}") for j in range(len(x))]).alias("_s"), "_n", "_bad")


def _solved(products: DataFrame, by: list[str], p: int) -> DataFrame:
    """by, _b (coefficients of standardized columns), _g (inverse of their products, row by row), _status."""
    kinds = ", ".join([*(f"{c} {t}" for c, t in products.dtypes if c in by), "_b array<double>", "_g array<double>", "_status string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, bad, s, c in zip(b["_n"], b["_bad"], b["_products"], b["_cross"]):
                s = np.array(s, float).reshape(p, p)
                fine = not bad and n > p + 1 and np.isfinite(s).all() and np.linalg.eigvalsh(s / n)[0] > RANK * p
                if fine:
                    g = np.linalg.inv(s)
                    rows.append(((g @ np.array(c, float)).tolist(), g.ravel().tolist(), OK))
                else:
                    rows.append((None, None, "not estimable: rank"))
            yield pd.concat([b[by].reset_index(drop=True), pd.DataFrame(rows, columns=["_b", "_g", "_status"])], axis=1)

    return products.mapInPandas(run, kinds)


def influence_of_rows(df: DataFrame, by: list[str], value: str, columns: list[str], keep: list[str]) -> DataFrame:
    """by, keep, _h (leverage), _e (residual), _loo (first column's coefficient without the row), _b0 (with it), _step (its share of the sandwich), _inflation, _n, _s, _status."""
    p = len(columns)
    z = [F.col(f"_z{j}") for j in range(p)]
    rows = standardized_rows(df, by, value, columns, keep)
    cross = [F.sum(z[j] * z[k]).alias(f"_p{j}_{k}") for j in range(p) for k in range(j, p)]
    made = rows.groupBy(*by).agg(F.first("_n").alias("_n"), F.first("_bad").alias("_bad"), *cross, *[F.sum(z[j] * F.col("_w")).alias(f"_c{j}") for j in range(p)])
    square = F.array(*[F.col(f"_p{min(j, k)}_{max(j, k)}") for j in range(p) for k in range(p)])
    solved = _solved(made.select(*by, "_n", "_bad", square.alias("_products"), F.array(*[F.col(f"_c{j}") for j in range(p)]).alias("_cross")), by, p)
    out = _back(rows, solved, by)
    g = lambda j, k: F.col("_g")[j * p + k]
    gz = [_sum([g(j, k) * z[k] for k in range(p)]) for j in range(p)]
    out = out.withColumn("_gz0", gz[0]).withColumn("_h", 1 / F.col("_n") + _sum([z[j] * gz[j] for j in range(p)])).withColumn("_e", F.col("_w") - _sum([z[j] * F.col("_b")[j] for j in range(p)]))
    # a leverage of one has no row left out: such groups are refused
    one = F.nullif(F.when(F.col("_h") < LEVERAGE, 1 - F.col("_h")), F.lit(0.0))
    step = F.col("_gz0") * F.col("_e") / one
    s0 = F.nullif(F.col("_s")[0], F.lit(0.0))
    return out.select(*by, *keep, "_h", "_e", ((F.col("_b")[0] - step) / s0).alias("_loo"), (F.col("_b")[0] / s0).alias("_b0"), (step / s0).alias("_step"), (g(0, 0) * F.col("_n")).alias("_inflation"), "_n", "_status")


def gram(df: DataFrame, by: list[str], columns: list[Column], weight: Column) -> DataFrame:
    """by, products: the weighted sums of products of all pairs of columns, row by row."""
    p = len(columns)
    named = df.select(*by, weight.cast("double").alias("_m"), *[c.cast("double").alias(f"_x{j}") for j, c in enumerate(columns)])
    cells = [F.sum(F.col("_m") * F.col(f"_x{j}") * F.col(f"_x{k}")).alias(f"_p{j}_{k}") for j in range(p) for k in range(j, p)]
    return named.groupBy(*by).agg(*cells).select(*by, F.array(*[F.col(f"_p{min(j, k)}_{max(j, k)}") for j in range(p) for k in range(p)]).alias("products"))


def full_rank(s: np.ndarray) -> bool:
    """Whether a matrix of products is finite and has the rank of its size, whatever the columns' scales."""
    d = np.sqrt(np.diag(s))
    return bool(np.isfinite(s).all() and (d > 0).all() and np.linalg.eigvalsh(s / np.outer(d, d))[0] > RANK * len(s))


def coefficients(df: DataFrame, by: list[str], value: str, columns: list[str], weight: Column) -> DataFrame:
    """by, beta (the intercept first), status (ok or rank) of each group's weighted least-squares fit."""
    p = 1 + len(columns)
    sums = gram(df, by, [F.lit(1.0), *[F.col(c) for c in columns], F.col(value)], weight)
    kinds = ", ".join([*(f"{c} {t}" for c, t in sums.dtypes if c in by), "beta array<double>", "status string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for entries in b["products"]:
                s = np.array(entries, float).reshape(p + 1, p + 1)
                rows.append((np.linalg.solve(s[:p, :p], s[:p, p]).tolist(), OK) if np.isfinite(s).all() and full_rank(s[:p, :p]) else (None, "rank"))
            yield pd.concat([b[by].reset_index(drop=True), pd.DataFrame(rows, columns=["beta", "status"])], axis=1)

    return sums.mapInPandas(run, kinds)


def _deviation(df: DataFrame, by: list[str], value: str, response: str) -> DataFrame:
    """by, _sd: deviation of value within the response's groups, each of which needs two rows."""
    y, v = F.col(response), F.col(value).cast("double")
    n = [F.count_if(y == k) for k in (0, 1)]
    var = [F.var_samp(F.when(y == k, v)) for k in (0, 1)]
    total = (n[0] - 1) * var[0] + (n[1] - 1) * var[1]
    return df.groupBy(*by).agg(F.sqrt(total / F.nullif(n[0] + n[1] - 2, F.lit(0))).alias("_sd"))


ASSOCIATION = "estimate double, se double, lo double, hi double, p double, standardized double, max_cooks double, max_leverage double, loo_min double, loo_max double, sign_changes int, n int"


def associations(df: DataFrame, by: list[str], value: str, response: str, covariates: list[str], with_influence: bool = True, with_status: bool = False) -> DataFrame:
    """by and ASSOCIATION: HC3 effect of the response on each group's value given covariates, also over the pooled standard deviation.

    with_status: a further column status; without it, a group that can't be fitted fails the query.
    """
    p = 1 + len(covariates)
    rows = influence_of_rows(df, by, value, [response, *covariates], [])
    cooks = F.col("_e") * F.col("_e") * F.col("_h") / ((1 - F.col("_h")) * (1 - F.col("_h")))
    sums = rows.groupBy(*by).agg(
        F.first("_n").alias("n"), F.first("_status").alias("_status"), F.first("_b0").alias("estimate"), F.sum(F.col("_step") * F.col("_step")).alias("_var"), F.sum(F.col("_e") * F.col("_e")).alias("_sse"),
        F.max("_h").alias("max_leverage"), F.max(F.when(F.col("_h") < LEVERAGE, cooks)).alias("_cooks"), F.min("_loo").alias("_low"), F.max("_loo").alias("_high"), F.count_if(F.signum("_loo") != F.signum("_b0")).cast("int").alias("sign_changes"),
    )
    out = _back(sums, _deviation(df, by, value, response), by)
    dof = F.col("n") - p - 1
    status = F.when(F.col("_status") != OK, F.col("_status")).when(F.col("max_leverage") >= LEVERAGE, "not estimable: leverage").when(~F.coalesce(F.col("_sd") > 0, F.lit(False)), "not estimable: deviation").otherwise(OK)
    out = out.withColumn("status", status)
    figures = {"estimate": F.col("estimate"), "se": F.sqrt("_var"), "standardized": F.col("estimate") / F.nullif(F.col("_sd"), F.lit(0.0)), "max_leverage": F.col("max_leverage"), "max_cooks": F.col("_cooks") * dof / (F.nullif(F.col("_sse"), F.lit(0.0)) * (p + 1)), "_dof": dof.cast("double")}
    influence = {"loo_min": F.col("_low") / F.nullif(F.col("_sd"), F.lit(0.0)), "loo_max": F.col("_high") / F.nullif(F.col("_sd"), F.lit(0.0)), "sign_changes": F.col("sign_changes")}
    if not with_influence:
        influence = {"loo_min": F.lit(None).cast("double"), "loo_max": F.lit(None).cast("double"), "sign_changes": F.lit(None).cast("int")}
    fine = F.col("status") == OK
    out = out.select(*by, F.col("n").cast("int").alias("n"), *[F.when(fine, c).alias(k) for k, c in (figures | influence).items()], "status")
    if not with_status:
        out = out.withColumn("status", F.when(fine, F.col("status")).otherwise(F.raise_error(F.concat_ws(": ", *[F.col(c).cast("string") for c in by], F.col("status")))))
    return _tested(out, by).select(*by, *[x.split()[0] for x in ASSOCIATION.split(", ")], *(["status"] if with_status else []))


def _tested(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows, one a group, with p, lo and hi of estimate, se and _dof by Student's distribution."""
    kinds = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), "p double", "lo double", "hi double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p, lo, hi = [], [], []
            for e, s, dof in zip(b["estimate"], b["se"], b["_dof"]):
                ok = not (pd.isna(e) or pd.isna(s) or s <= 0)
                half = t_quantile(0.975, int(dof)) * s if ok else math.nan
                p.append(t_two_sided(e / s, int(dof)) if ok else None)
                lo.append(e - half if ok else None)
                hi.append(e + half if ok else None)
            yield b.assign(p=pd.Series(p, dtype=float, index=b.index), lo=pd.Series(lo, dtype=float, index=b.index), hi=pd.Series(hi, dtype=float, index=b.index))

    out = rows.mapInPandas(run, kinds)
    # pandas has NaN where a figure is null
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in out.dtypes if t == "double" and c not in by})


INFLUENCE = "row_pos long, coefficient double, change double, sign_changed boolean, leverage double, cooks double, vif double"


def influence_rows(df: DataFrame, by: list[str], value: str, response: str, covariates: list[str], with_status: bool = False) -> DataFrame:
    """by and INFLUENCE: for each person the response's standardized coefficient without them, its change, leverage and Cook's distance; the response's variance inflation.

    with_status: a further column status; without it, a group that can't be fitted fails the query.
    """
    p = 1 + len(covariates)
    rows = influence_of_rows(df, by, value, [response, *covariates], ["row_pos"])
    whole = _back(rows.groupBy(*by).agg(F.sum(F.col("_e") * F.col("_e")).alias("_sse"), F.max("_h").alias("_top")), _deviation(df, by, value, response), by)
    out = _back(rows, whole, by)
    status = F.when(F.col("_status") != OK, F.col("_status")).when(F.col("_top") >= LEVERAGE, "not estimable: leverage").when(~F.coalesce(F.col("_sd") > 0, F.lit(False)), "not estimable: deviation").otherwise(OK)
    out = out.withColumn("status", status)
    fine, sd, h = F.col("status") == OK, F.nullif(F.col("_sd"), F.lit(0.0)), F.col("_h")
    one = F.nullif(F.when(h < LEVERAGE, (1 - h) * (1 - h)), F.lit(0.0))
    cells = {"coefficient": F.col("_loo") / sd, "change": (F.col("_loo") - F.col("_b0")) / sd, "sign_changed": F.signum("_loo") != F.signum("_b0"), "leverage": h, "cooks": F.col("_e") * F.col("_e") * h / one * (F.col("_n") - p - 1) / (F.nullif(F.col("_sse"), F.lit(0.0)) * (p + 1)), "vif": F.col("_inflation")}
    out = out.select(*by, "row_pos", *[F.when(fine, c).alias(k) for k, c in cells.items()], "status")
    if with_status:
        return out
    return out.withColumn("row_pos", F.when(fine, F.col("row_pos")).otherwise(F.raise_error(F.concat_ws(": ", *[F.col(c).cast("string") for c in by], F.col("status"))).cast("long"))).drop("status")
