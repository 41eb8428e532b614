"""The clinical bridge: component scores against epilepsy type, response and regions, over fixed resamples.

A fit that a draw does not allow is counted under its reason, never redrawn, and an
interval says when fewer than 95 % of draws are valid. bridge_draws() has a draw as
one kernel call, for a small study's arrays; adjusted_draws() has all draws as
tables: people's scores are made where the people are, and each analysis is an
aggregation by draw. block_draws() has the same rows without a table of draws and
people, for thousands of draws of large cohorts (see operators.drawn).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators import drawn, least_squares, linear, newton
from cohortloom.operators.metrics import percentile_interval
from cohortloom.operators.ranking import _bucketed, holm
from cohortloom.operators.weights import BLOCK, SLICE, block_weights
from cohortloom.sources.workspace import shared_folder

VALID_SHARE = 0.95


def repeated_scores(clr: np.ndarray, rows: np.ndarray, loading: np.ndarray, scale: float) -> np.ndarray:
    """Scores of drawn rows, each person projected once: copies of a person have the very same score, so that ranks tie exactly."""
    rows = np.asarray(rows)
    people, back = np.unique(rows, return_inverse=True)
    centre = clr[rows].mean(axis=0)
    return np.array([float((clr[k] - centre) @ loading / scale) for k in people])[back]


DRAW = "draw long, quantity string, value double, status string"


def bridge_draws(draws: DataFrame, clr: np.ndarray, y: np.ndarray, types: np.ndarray, others: np.ndarray, scale: float) -> DataFrame:
    """DRAW rows for each of draws (draw, rows, loading): the types' two contrasts and their difference, the response's log odds, and a
    Spearman correlation with each column of others. types: 0/1 columns of a three-level factor. The arrays are one study's tables."""

    def run(batches):
        for pdf in batches:
            out = []
            for draw, rows, loading in zip(pdf["draw"], pdf["rows"], pdf["loading"]):
                at, s = np.asarray(rows), repeated_scores(clr, rows, np.asarray(loading), scale)

                def note(name, f):
                    try:
                        out.extend((draw, n, float(v), "PASS") for n, v in f().items())
                    except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                        out.append((draw, name, None, f"{type(e).__name__}: {e}"))

                def contrasts():
                    a = np.column_stack([np.ones(len(at)), types[at]])
                    if np.linalg.matrix_rank(a) < a.shape[1]:
                        raise ValueError("the design's columns depend on each other")
                    b = np.linalg.lstsq(a, s, rcond=None)[0]
                    return {"type_1": b[1], "type_2": b[2], "type_difference": b[1] - b[2]}

                def odds():
                    return {"response": linear.logistic(np.column_stack([np.ones(len(at)), s]), y[at])[0][1]}

                def correlations():
                    r = linear.ranks(s)
                    return {f"region_{k}": np.corrcoef(r, linear.ranks(c))[0, 1] for k, c in enumerate(others[at].T)}

                note("type", contrasts)
                note("response", odds)
                note("region", correlations)
            yield pd.DataFrame(out, columns=["draw", "quantity", "value", "status"])

    return draws.mapInPandas(run, DRAW)


def bridge_intervals(rows: DataFrame, total: int) -> DataFrame:
    """quantity, lo, hi, valid, total, scope of bridge_draws() (a written table)."""
    valid = rows.where("status = 'PASS'")
    n = valid.groupBy("quantity").agg(F.count(F.lit(1)).alias("valid"))
    out = percentile_interval(valid, "value", ["quantity"], bounded=True).join(n, "quantity").withColumn("total", F.lit(total))
    full = F.lit("percentile over people with reestimated components")
    diagnostic = F.when(F.col("quantity") == "response", "diagnostic only: over 5 % of fits are invalid").otherwise("percentile conditional on valid fits")
    return out.withColumn("scope", F.when(F.col("valid") >= VALID_SHARE * total, full).otherwise(diagnostic))


def failures(rows: DataFrame) -> DataFrame:
    """quantity, status, n of the draws that failed."""
    return rows.where("status <> 'PASS'").groupBy("quantity", "status").agg(F.count(F.lit(1)).alias("n"))


def primary_tests(rows: DataFrame) -> DataFrame:
    """(test, p) of the primary tests with Holm's adjusted p."""
    return holm(rows.withColumn("_f", F.lit(1)), "p", ["_f"], ["test"]).drop("_f")


#: Entries of all draws' loadings at most: 64 MB go along with the tasks.
BUNDLE = 8_000_000


def draw_scores(rows: DataFrame, loadings: DataFrame, n: int, draws: int, seed: int, scale: float, folder: str, size: int = BLOCK) -> DataFrame:
    """draw, row_pos, weight, score of every person that a draw has: (z - the draw's mean) times its loading, over scale.

    rows: row_pos from 0 to n - 1 and z; loadings: draw, loading, of the same draws and seed. Copies of a person are one
    row with a weight and so have the very same score.
    """
    known = {r["draw"]: r["loading"] for r in loadings.where("loading is not null").select("draw", "loading").collect()}
    if sum(map(len, known.values())) > BUNDLE:
        raise ValueError("the loadings of all draws are too large a bundle")
    at = np.array(sorted(known), int)
    table = np.array([known[d] for d in at.tolist()], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = b.column(0).to_numpy()
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(pos), -1)
            for block in np.unique(pos // size):
                mine = np.flatnonzero(pos // size == block)
                w = block_weights(int(block), n, draws, seed, size)[:, pos[mine] - block * size]
                for k in range(0, len(at), SLICE):
                    part = at[k : k + SLICE]
                    d, j = np.nonzero(w[part])
                    u = table[k : k + SLICE] @ x[mine].T
                    yield pa.RecordBatch.from_arrays([pa.array(part[d]), pa.array(pos[mine][j]), pa.array(w[part][d, j]), pa.array(u[d, j])], ["draw", "row_pos", "weight", "u"])

    made = rows.select(F.col("row_pos").cast("long"), F.col("z").cast("array<double>")).mapInArrow(run, "draw long, row_pos long, weight long, u double") if len(at) else rows.sparkSession.createDataFrame([], "draw long, row_pos long, weight long, u double")
    made.write.mode("overwrite").parquet(f"{folder}/u")
    made = rows.sparkSession.read.schema(made.schema).parquet(f"{folder}/u")
    mean = made.groupBy("draw").agg((F.sum(F.col("weight") * F.col("u")) / F.sum("weight")).alias("_mean"))
    # a row a draw, of as many draws as there are loadings
    return made.join(F.broadcast(mean), "draw").select("draw", "row_pos", "weight", ((F.col("u") - F.col("_mean")) / scale).alias("score"))


def drawn_ranks(people: DataFrame, columns: list[str]) -> DataFrame:
    """draw, row_pos, weight and r_<column>: average ranks within each draw, in which a row counts as often as its weight says."""
    # rows go to their bucket of values once, and once back to their person
    long = people.select("draw", "row_pos", "weight", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double") + F.lit(0.0))])).alias("variable", "v"))
    placed = _bucketed(long, ["draw", "variable"], "v", True)
    totals = placed.groupBy("draw", "variable", "_bucket").agg(F.sum("weight").alias("_t"))
    upto = Window.partitionBy("draw", "variable").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("draw", "variable", "_bucket", F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_s"))
    inside = Window.partitionBy("draw", "variable", "_bucket").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = F.sum("weight").over(Window.partitionBy("draw", "variable", "_bucket", "v"))
    met = placed.join(before.hint("merge"), ["draw", "variable", "_bucket"])
    met = met.select("draw", "variable", "row_pos", "weight", F.when(F.col("v").isNotNull(), F.col("_s") + F.sum("weight").over(inside) - (ties - 1) / 2).alias("_r"))
    return met.groupBy("draw", "row_pos").agg(F.first("weight").alias("weight"), *[F.max(F.when(F.col("variable") == c, F.col("_r"))).alias(f"r_{c}") for c in columns])


def _correlations(draw: int, s: np.ndarray, q: int, regions: list[str]) -> list[tuple]:
    """DRAW rows raw_<region> and partial_<region> from products of a design's q columns (1 first), the score's ranks and the regions'."""

    def left(used: list[int]) -> np.ndarray:
        """Correlations of the first of the others with the rest, given the columns used."""
        t = s[q:, q:] - s[q:, used] @ np.linalg.solve(s[np.ix_(used, used)], s[np.ix_(used, range(q, len(s)))])
        d = np.sqrt(np.maximum(np.diag(t), 0))
        if (d <= 1e-9 * np.sqrt(np.diag(s)[q:])).any():
            raise ValueError("a ranking has no spread")
        return np.clip(t[0, 1:] / (d[0] * d[1:]), -1, 1)

    rows = []
    for kind, used in (("raw", [0]), ("partial", list(range(q)))):
        try:
            if not least_squares.full_rank(s[np.ix_(used, used)]):
                raise ValueError("the design's columns depend on each other")
            rows += [(draw, f"{kind}_{r}", float(v), "PASS") for r, v in zip(regions, left(used))]
        except ValueError as e:
            rows += [(draw, f"{kind}_{r}", None, f"ValueError: {e}") for r in regions]
    return rows


def drawn_correlations(people: DataFrame, regions: list[str], ranked: list[str], plain: list[str]) -> DataFrame:
    """DRAW rows raw_<region> and partial_<region>: Spearman correlation of the score with each region, and that of what a design of
    1, ranks of `ranked` and the columns `plain` leaves of both rankings."""
    ranks = drawn_ranks(people, ["score", *regions, *ranked]).join(people.select("draw", "row_pos", *plain), ["draw", "row_pos"])
    design = [F.lit(1.0), *[F.col(f"r_{c}") for c in ranked], *[F.col(c) for c in plain]]
    sums = least_squares.gram(ranks, ["draw"], [*design, F.col("r_score"), *[F.col(f"r_{c}") for c in regions]], F.col("weight"))
    q = len(design)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for draw, entries in zip(b["draw"], b["products"]):
                rows += _correlations(draw, np.array(entries, float).reshape(q + 1 + len(regions), -1), q, regions)
            yield pd.DataFrame(rows, columns=["draw", "quantity", "value", "status"])

    return sums.mapInPandas(run, DRAW)


def adjusted_draws(scores: DataFrame, cohort: DataFrame, types: dict[str, tuple[list[str], list[str]]], responses: dict[str, list[str]], regions: list[str], ranked: list[str], plain: list[str], folder: str | None = None) -> DataFrame:
    """DRAW rows of every analysis of every draw, a written table.

    scores: as of draw_scores(); cohort: row_pos, y and numeric columns. types: for each design its covariates and the
    two 0/1 columns of a three-level factor, whose contrasts and their difference are told; responses: for each design
    the covariates beside the score, whose log odds is told; regions: as in drawn_correlations().
    """
    folder = folder or shared_folder(cohort.sparkSession, "bridge")
    scores.join(cohort, "row_pos").withColumn("_one", F.lit(1.0)).write.mode("overwrite").parquet(f"{folder}/people")
    people = cohort.sparkSession.read.parquet(f"{folder}/people")
    parts = []
    state = lambda c, ok: F.when(c == ok, "PASS").otherwise(c)
    for name, (covariates, levels) in types.items():
        found = least_squares.coefficients(people, ["draw"], "score", [*covariates, *levels], F.col("weight"))
        at = len(covariates) + 1
        one, two = F.get("beta", F.lit(at)), F.get("beta", F.lit(at + 1))
        cells = F.array(*[F.struct(F.lit(f"{name}_{q}").alias("quantity"), v.alias("value")) for q, v in (("type_1", one), ("type_2", two), ("type_difference", one - two))])
        parts.append(found.select("draw", F.explode(cells).alias("c"), state(F.col("status"), least_squares.OK).alias("status")).select("draw", "c.quantity", "c.value", "status"))
    for name, covariates in responses.items():
        found = newton.fits(people, ["draw"], "y", ["_one", "score", *covariates], weight=F.col("weight"))
        parts.append(found.select("draw", F.lit(f"{name}_response").alias("quantity"), F.when(F.col("status") == newton.OK, F.col("beta")[1]).alias("value"), state(F.col("status"), newton.OK).alias("status")))
    parts.append(drawn_correlations(people, regions, ranked, plain))
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(f"{folder}/draws")
    return cohort.sparkSession.read.schema(DRAW).parquet(f"{folder}/draws")


def block_draws(rows: DataFrame, draws: drawn.Draws, types: dict[str, tuple[list[str], list[str]]], responses: dict[str, list[str]], regions: list[str], ranked: list[str], plain: list[str], folder: str | None = None) -> DataFrame:
    """As adjusted_draws(), a written table, of rows (row_pos from 0 to n - 1, z, y and numeric columns) and their draws. A value that
    isn't finite fails each analysis with its column in the draws that have it."""
    spark = rows.sparkSession
    folder = folder or shared_folder(spark, "bridge")
    used = [*(c for x, levels in types.values() for c in (*x, *levels)), *(c for x in responses.values() for c in x), *regions, *ranked, *plain]
    names = ["y", *dict.fromkeys(c for c in used if c != "y")]
    at = {c: k for k, c in enumerate(names)}
    if not len(draws.at):
        spark.createDataFrame([], DRAW).write.mode("overwrite").parquet(f"{folder}/draws")
        return spark.read.schema(DRAW).parquet(f"{folder}/draws")
    blocks = drawn.dealt(rows.withColumn("y", F.when(F.col("y").isin(0, 1), F.col("y"))), names, draws.size, folder)
    sums = drawn.products(blocks, draws, len(names))
    draws = drawn.with_means(draws, sums)
    odd = lambda columns: (sums.odd[:, [at[c] for c in columns]] > 0).any(axis=1)
    out = []
    for name, (covariates, levels) in types.items():
        x, bad = [0, *(1 + at[c] for c in (*covariates, *levels))], odd([*covariates, *levels])
        for k, draw in enumerate(draws.at.tolist()):
            s = sums.xx[k][np.ix_(x, x)]
            if bad[k] or not np.isfinite(s).all() or not least_squares.full_rank(s):
                out += [(draw, f"{name}_{q}", None, "rank") for q in ("type_1", "type_2", "type_difference")]
                continue
            b = np.linalg.solve(s, (sums.xu[k, x] - draws.mean[k] * sums.xx[k, x, 0]) / draws.scale)[-2:].tolist()
            out += [(draw, f"{name}_{q}", v, "PASS") for q, v in (("type_1", b[0]), ("type_2", b[1]), ("type_difference", b[0] - b[1]))]
    ones, all_ = sums.xx[:, 0, 1], sums.xx[:, 0, 0]
    one_class = (ones == 0) | (ones == all_)
    begin = np.array([np.where(odd(["y", *x]), "rank", np.where(one_class, "single class", newton.MOVING)) for x in responses.values()], object).reshape(len(responses), len(draws.at)).T
    status, beta = drawn.logistic(blocks, draws, at["y"], [[at[c] for c in x] for x in responses.values()], begin)
    for g, name in enumerate(responses):
        for k, draw in enumerate(draws.at.tolist()):
            fine = status[k, g] == newton.OK
            out.append((draw, f"{name}_response", float(beta[g][k, 1]) if fine else None, "PASS" if fine else status[k, g]))
    told = spark.createDataFrame(out, DRAW)
    if regions:
        columns, p = [*regions, *ranked], len(plain)
        # the design's columns, the score, the regions
        order = [0, *range(2 + p + len(regions), 2 + p + len(columns)), *range(1, 1 + p), 1 + p, *range(2 + p, 2 + p + len(regions))]
        q = 1 + len(ranked) + p
        none = {"raw": [odd([r]) for r in regions], "partial": [odd([r, *ranked, *plain]) for r in regions]}
        places = draws.at.tolist()

        def finish(first: int, m: np.ndarray) -> pd.DataFrame:
            made = []
            for k, s in enumerate(m, first):
                for j, r in enumerate(_correlations(places[k], s[np.ix_(order, order)], q, regions)):
                    kind, region = ("raw", j) if j < len(regions) else ("partial", j - len(regions))
                    made.append((*r[:2], None, "ValueError: a value isn't finite") if none[kind][region][k] else r)
            return pd.DataFrame(made, columns=["draw", "quantity", "value", "status"])

        told = told.unionByName(drawn.rank_products(blocks, draws, [at[c] for c in columns], [at[c] for c in plain], finish, DRAW))
    told.write.mode("overwrite").parquet(f"{folder}/draws")
    return spark.read.schema(DRAW).parquet(f"{folder}/draws")
