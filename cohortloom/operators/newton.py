"""Unpenalized logistic fits of many groups at once, of any size, with profile-likelihood bounds.

A step of all groups is one aggregation over their rows: log-likelihood, score and
information at each group's coefficients, which are joined to its rows. What a
group does next follows from its own figures, in a table with a row a group: it
takes a Newton step, halves one that made the likelihood worse, or stops, with
its status. Rounds go on until no group moves; their number depends on the
slowest group, not on how many there are. The table of states is written in each
round to a shared folder, so that plans don't grow.

A profile bound is the point on the curve of best fits for a fixed coefficient at
which the likelihood has fallen by half a chi-square quantile. Its steps solve the
same quadratic model: of all moves d with g + lambda e = A d, that which brings the
model's likelihood to the target, where g is the score, A the information, e the
coefficient's unit vector.

Columns that are 0 in all of a group's rows keep the coefficient 0. Statuses:
OK; `single class`; `rank` (columns that depend on each other, values that aren't
finite); `separated` (a coefficient or the information runs away); `no
convergence`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import expit, finite, softplus
from cohortloom.functions.distributions import chi2_quantile, chi2_upper
from cohortloom.operators.least_squares import _back, _sum
from cohortloom.sources.workspace import shared_folder

OK = "ok"
SCORE, ROUNDS, FARTHEST, CONDITION, RANK = 1e-9, 80, 40.0, 1e12, 1e-12
STATE = "beta array<double>, value double, trial array<double>, move array<double>, size double, status string, info array<double>"
#: No further round is needed for a group with any of these.
MOVING = "moving"


def _figures(rows: DataFrame, by: list[str], p: int, state: DataFrame) -> DataFrame:
    """by, _l, _g, _a: log-likelihood, score and information (upper triangle) at each moving group's trial coefficients."""
    met = _back(rows, state.where(F.col("status") == MOVING).select(*by, "trial"), by)
    x = [F.col(f"_x{j}") for j in range(p)]
    eta = F.col("_offset") + _sum([x[j] * F.col("trial")[j] for j in range(p)])
    met = met.withColumn("_eta", eta).withColumn("_p", expit(F.col("_eta"))).withColumn("_w", F.col("_p") * (1 - F.col("_p")))
    signed = F.when(F.col("_y") == 1, -F.col("_eta")).otherwise(F.col("_eta"))
    m = F.col("_m")
    cells = [F.sum(-softplus(signed) * m).alias("_l"), *[F.sum(x[j] * (F.col("_y") - F.col("_p")) * m).alias(f"_g{j}") for j in range(p)], *[F.sum(x[j] * x[k] * F.col("_w") * m).alias(f"_a{j}_{k}") for j in range(p) for k in range(j, p)]]
    got = met.groupBy(*by).agg(*cells)
    return got.select(*by, "_l", F.array(*[F.col(f"_g{j}") for j in range(p)]).alias("_g"), F.array(*[F.col(f"_a{min(j, k)}_{max(j, k)}") for j in range(p) for k in range(p)]).alias("_a"))


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _numeric(df: DataFrame, by: list[str], y: str, columns: list[str], offset: Column | None, weight: Column | None = None) -> DataFrame:
    x = [F.col(c).cast("double") for c in columns]
    m = F.lit(1.0) if weight is None else weight.cast("double")
    good = reduce(lambda a, b: a & b, [finite(c) for c in (*x, m, F.lit(0.0) if offset is None else offset)]) & F.coalesce(F.col(y).isin(0, 1), F.lit(False))
    return df.select(*by, F.col(y).cast("int").alias("_y"), (F.lit(0.0) if offset is None else offset.cast("double")).alias("_offset"), m.alias("_m"), *[c.alias(f"_x{j}") for j, c in enumerate(x)], (~good).alias("_odd"))


def _beginning(rows: DataFrame, by: list[str], p: int) -> DataFrame:
    """The state before the first round, of every group."""
    x = [F.col(f"_x{j}") for j in range(p)]
    s = rows.groupBy(*by).agg(F.count_if("_odd").alias("_bad"), F.count_distinct("_y").alias("_classes"))
    zero, none = F.array(*[F.lit(0.0)] * len(x)), F.lit(None)
    status = F.when(F.col("_bad") > 0, "rank").when(F.col("_classes") < 2, "single class").otherwise(MOVING)
    return s.select(*by, zero.alias("beta"), none.cast("double").alias("value"), zero.alias("trial"), zero.alias("move"), F.lit(1.0).alias("size"), status.alias("status"), none.cast("array<double>").alias("info"))


def _advanced(row: dict, p: int) -> dict:
    """A group's next state from its figures at the trial coefficients."""
    l, g, a = row["_l"], np.array(row["_g"], float), np.array(row["_a"], float).reshape(p, p)
    keep = {k: row[k] for k in ("beta", "value", "trial", "move", "size", "info")}
    if row["value"] is not None and not pd.isna(row["value"]) and not l >= row["value"] - 1e-12 * (1 + abs(row["value"])):
        size = row["size"] / 2
        if size < 1e-8:
            return keep | {"status": "no convergence"}
        return keep | {"size": size, "trial": (np.array(row["beta"]) + size * np.array(row["move"])).tolist(), "status": MOVING}
    used = np.flatnonzero(np.diag(a) > 0)
    part = a[np.ix_(used, used)]
    scale = np.sqrt(np.diag(part))
    even = np.linalg.eigvalsh(part / np.outer(scale, scale)) if len(used) else np.array([0.0])
    beta = np.array(row["trial"], float)
    now = keep | {"beta": beta.tolist(), "value": l, "info": a.ravel().tolist(), "size": 1.0}
    if even[0] < RANK:
        return now | {"status": "rank" if row["value"] is None or pd.isna(row["value"]) else "separated"}
    if np.abs(beta).max() > FARTHEST or np.linalg.cond(part) > CONDITION:
        return now | {"status": "separated"}
    if np.abs(g).max() < SCORE * (1 + np.abs(l)):
        return now | {"status": OK}
    move = np.zeros(p)
    move[used] = np.linalg.solve(part, g[used])
    return now | {"move": move.tolist(), "trial": (beta + move).tolist(), "status": MOVING}


def _stepped(met: DataFrame, by: list[str], columns: list[str], kinds: str, step) -> DataFrame:
    """by and columns of each row of met, one a group, after step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = [step(r) for r in b.to_dict("records")]
            yield pd.concat([b[by].reset_index(drop=True), pd.DataFrame(new, columns=columns)], axis=1)

    keys = ", ".join(f"{c} {t}" for c, t in met.dtypes if c in by)
    return met.mapInPandas(run, ", ".join(x for x in (keys, kinds) if x))


def _rounds(rows: DataFrame, by: list[str], p: int, state: DataFrame, folder: str, tag: str, kinds: str, step, limit: int = ROUNDS) -> DataFrame:
    """state after as many rounds as it takes until no group moves."""
    columns = [x.split()[0] for x in kinds.split(", ")]
    state = _written(state, folder, f"{tag}0")
    for k in range(1, limit + 1):
        if state.where(F.col("status") == MOVING).isEmpty():
            return state
        moved = _back(state.where(F.col("status") == MOVING), _figures(rows, by, p, state), by)
        after = _stepped(moved, by, columns, kinds, step).unionByName(state.where(F.col("status") != MOVING))
        state = _written(after, folder, f"{tag}{k}")
    return state.withColumn("status", F.when(F.col("status") == MOVING, "no convergence").otherwise(F.col("status")))


def fits(df: DataFrame, by: list[str], y: str, columns: list[str], offset: Column | None = None, weight: Column | None = None) -> DataFrame:
    """by, beta, value (log-likelihood), info (row by row), status: the maximum-likelihood fit of each group. Rows are written once and
    read in each round; a row counts `weight` times, which is above 0."""
    folder, p = shared_folder(df.sparkSession, "newton"), len(columns)
    rows = _written(_numeric(df, by, y, columns, offset, weight), folder, "rows")
    return _rounds(rows, by, p, _beginning(rows, by, p), folder, "state", STATE, lambda r: _advanced(r, p)).select(*by, "beta", "value", "info", "status")


def calibration(df: DataFrame, by: list[str], y: str = "y", prob: str = "p", clip: float = 1e-6) -> DataFrame:
    """by, status, offset, intercept, slope of (y, p) in each group: calibration in the large (slope 1) and the joint fit, both in the same rounds."""
    q = F.least(F.greatest(F.col(prob).cast("double"), F.lit(clip)), F.lit(1 - clip))
    z = F.when(F.col(prob).isNotNull(), F.ln(q / (1 - q)))
    both = df.select(*by, F.col(y).alias("_cy"), z.alias("_cz")).withColumn("_fit", F.explode(F.array(F.lit("large"), F.lit("joint"))))
    large = F.col("_fit") == "large"
    rows = both.withColumns({"_one": F.lit(1.0), "_slope": F.when(large, F.when(F.col("_cz").isNotNull(), 0.0)).otherwise(F.col("_cz"))})
    got = fits(rows, [*by, "_fit"], "_cy", ["_one", "_slope"], F.when(large, F.col("_cz")).otherwise(F.when(F.col("_cz").isNotNull(), 0.0)))
    pick = lambda name, c: F.first(F.when(F.col("_fit") == name, c), ignorenulls=True)
    wide = got.groupBy(*by).agg(pick("large", F.col("beta")[0]).alias("_large"), pick("large", F.col("status")).alias("_ls"), pick("joint", F.col("beta")).alias("_joint"), pick("joint", F.col("status")).alias("_js"))
    spread = df.groupBy(*by).agg((F.max(z) - F.min(z) < 1e-10).alias("_flat"))
    out = _back(wide, spread, by)
    status = (
        F.when(F.col("_js") == "single class", "NOT_ESTIMABLE_SINGLE_CLASS")
        .when(F.col("_flat"), "CONSTANT_PREDICTIONS_SLOPE_NOT_ESTIMABLE")
        .when(F.col("_js") == OK, "ESTIMABLE")
        .otherwise("UNSTABLE_OR_SEPARATED")
    )
    ok = status == "ESTIMABLE"
    return out.select(*by, status.alias("status"), F.when(F.col("_ls") == OK, F.col("_large")).alias("offset"), F.when(ok, F.col("_joint")[0]).alias("intercept"), F.when(ok, F.col("_joint")[1]).alias("slope"))


BOUND = "beta array<double>, value double, trial array<double>, move array<double>, size double, status string, info array<double>, top double, side int"


def _bounded(row: dict, p: int, column: int, drop: float) -> dict:
    """A bound's next state: the move after which the quadratic model's other scores are 0 and its likelihood has dropped by `drop` from the top."""
    l, g, a = row["_l"], np.array(row["_g"], float), np.array(row["_a"], float).reshape(p, p)
    beta, target = np.array(row["trial"], float), row["top"] - drop
    now = {k: row[k] for k in ("info", "top", "side", "size", "move")} | {"beta": beta.tolist(), "value": l}
    if not np.isfinite(l) or np.abs(beta).max() > 20 * FARTHEST or np.linalg.cond(a) > CONDITION:
        return now | {"trial": beta.tolist(), "status": "separated"}
    back = np.linalg.inv(a)
    rest = np.delete(g, column)
    if abs(l - target) < 1e-9 and (not len(rest) or np.abs(rest).max() < 1e-7 * (1 + abs(l))):
        return now | {"trial": beta.tolist(), "status": OK}
    square = 2 * (l - target + 0.5 * g @ back @ g) / back[column, column]
    force = np.sqrt(max(square, 0.0)) * row["side"]
    unit = np.zeros(p)
    unit[column] = 1.0
    move = back @ (g + force * unit)
    # a step no longer than a few deviations keeps the model's promise within reach
    reach = np.abs(move / np.sqrt(np.diag(back))).max() / 4
    return now | {"trial": (beta + move / max(1.0, reach)).tolist(), "status": MOVING}


def profile(df: DataFrame, by: list[str], y: str, columns: list[str], column: str, level: float = 0.95) -> DataFrame:
    """by, status, log_or, lo, hi, lr, p: a column's log odds ratio with profile-likelihood bounds and likelihood-ratio test in each group."""
    spark, p, k = df.sparkSession, len(columns), columns.index(column)
    folder = shared_folder(spark, "profile")
    rows = _written(_numeric(df, by, y, columns, None), folder, "rows")
    full = _rounds(rows, by, p, _beginning(rows, by, p), folder, "full", STATE, lambda r: _advanced(r, p))
    # without the column: the same rows with 0 in its place
    without = rows.withColumn(f"_x{k}", F.when(F.col(f"_x{k}").isNotNull(), 0.0))
    less = _rounds(without, by, p, _beginning(without, by, p), folder, "less", STATE, lambda r: _advanced(r, p)).select(*by, F.col("value").alias("_less"), F.col("status").alias("_ls"))
    # both bounds of all groups in the same rounds, from the fit a normal quantile away
    sides = full.where(F.col("status") == OK).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    drop = chi2_quantile(level, 1) / 2

    def begin(row: dict) -> dict:
        a = np.array(row["info"], float).reshape(p, p)
        kept = {n: row[n] for n in ("info", "side", "size", "beta", "value")} | {"top": row["value"]}
        if np.linalg.cond(a) > CONDITION:  # the column, or another, is 0 in all rows
            return kept | {"move": row["beta"], "trial": row["beta"], "status": "rank"}
        back = np.linalg.inv(a)
        move = back[:, k] / np.sqrt(back[k, k]) * np.sqrt(2 * drop) * row["side"]
        return kept | {"move": move.tolist(), "trial": (np.array(row["beta"], float) + move).tolist(), "status": MOVING}

    names = [x.split()[0] for x in BOUND.split(", ")]
    keys = [*by, "_side"]
    start = _stepped(sides.withColumn("_side", F.col("side")), keys, names, BOUND, begin)
    twice = rows.withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(1))))
    ends = _rounds(twice, keys, p, start, folder, "bound", BOUND, lambda r: _bounded(r, p, k, drop))
    pick = lambda side, c: F.first(F.when(F.col("_side") == side, c), ignorenulls=True)
    wide = ends.groupBy(*by).agg(pick(-1, F.col("beta")[k]).alias("_lo"), pick(1, F.col("beta")[k]).alias("_hi"), F.count_if(F.col("status") != OK).alias("_open"))
    out = full.select(*by, F.col("status").alias("_fs"), F.col("beta")[k].alias("_b"), F.col("value").alias("_full"))
    on = lambda a, b: _left(a, b, by)
    out = on(on(out, less), wide)
    status = F.when(F.col("_fs") == "separated", "nonestimable_separation").when(F.col("_fs") != OK, F.concat(F.lit("not estimable: "), F.col("_fs"))).when(F.col("_ls") != OK, F.concat(F.lit("not estimable without the column: "), F.col("_ls"))).when(F.col("_open") > 0, "a bound isn't reached").otherwise("estimated")
    fine = status == "estimated"
    out = out.select(*by, status.alias("status"), F.when(fine, F.col("_b")).alias("log_or"), F.when(fine, F.col("_lo")).alias("lo"), F.when(fine, F.col("_hi")).alias("hi"), F.when(fine, F.greatest(F.lit(0.0), 2 * (F.col("_full") - F.col("_less")))).alias("lr"))
    kinds = ", ".join(f"{c} {t}" for c, t in out.dtypes if c not in by)
    tested = lambda r: {c: r[c] for c in ("status", "log_or", "lo", "hi", "lr")} | {"p": None if r["lr"] is None or pd.isna(r["lr"]) else chi2_upper(r["lr"], 1)}
    made = _stepped(out, by, ["status", "log_or", "lo", "hi", "lr", "p"], f"{kinds}, p double", tested)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("log_or", "lo", "hi", "lr", "p")})


def _left(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    keyed = b.select(*[F.col(c).alias(f"_k_{c}") for c in by], *[c for c in b.columns if c not in by])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by])
    return a.join(keyed, on, "left").drop(*[f"_k_{c}" for c in by])
