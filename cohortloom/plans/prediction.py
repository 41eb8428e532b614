"""Nested prediction as one grouped kernel: a task for each model, repeat and outer fold.

The plan table is joined with the cohort, and each task's rows meet once; the
number of tasks, not the size of a cohort, is what grows. A kernel never
replaces a failed fit: it returns a status, and results() fails on any but PASS.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import required
from cohortloom.operators import elastic_net, linear, metrics, resampling
from cohortloom.operators.contracts import ContractError
from cohortloom.sources.workspace import shared_folder, written


@dataclass(frozen=True)
class Settings:
    """Frozen choices of a study: grids, seeds, limits and column sets."""

    clinical: tuple[str, ...] = ("age_at_implant_years", "sex", "epilepsy_duration_reported_years", "log1p_baseline_monthly_frequency", "mri_lesional_status")
    categories: dict = field(default_factory=lambda: {"sex": ("female", "male"), "mri_lesional_status": ("nonlesional", "lesional")})
    c_grid: tuple[float, ...] = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0)
    l1_grid: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)
    seed: int = 20260909
    repeats: int = 20
    inner_folds: int = 3
    thresholds: tuple[float, ...] = tuple(round(0.1 * k, 1) for k in range(1, 10))
    max_missing: float = 0.2
    #: Seconds that one task of a model may take: checked between fits, not within one.
    seconds: float = 3600.0

    def __post_init__(self) -> None:
        if not (isinstance(self.seconds, (int, float)) and math.isfinite(self.seconds) and self.seconds > 0):
            raise ContractError("a time limit is a finite positive number")

    @classmethod
    def from_documents(cls, model: dict, regions: dict) -> tuple[Settings, list[str]]:
        """(settings, regional columns) of two frozen documents: all their entries are known, none is missing, and each has its own kind."""
        kinds = {"clinical": list, "categories": dict, "c_grid": list, "l1_grid": list, "seed": int, "repeats": int, "inner_folds": int, "thresholds": list, "max_missing": float, "seconds": float}
        if set(model) != set(kinds) or set(regions) != {"regions"}:
            raise ContractError(f"unknown or missing entries: {sorted(set(model) ^ set(kinds)) + sorted(set(regions) ^ {'regions'})}")
        for k, kind in kinds.items():
            if type(model[k]) is not kind or (kind is int and model[k] < 1):
                raise ContractError(f"{k} must be a {kind.__name__}" + (" of 1 or more" if kind is int else ""))
        for k in ("c_grid", "l1_grid", "thresholds"):
            if not model[k] or any(type(v) is not float or not math.isfinite(v) for v in model[k]) or sorted(set(model[k])) != model[k]:
                raise ContractError(f"{k} must be rising finite numbers")
        names = regions["regions"]
        if not isinstance(names, list) or not names or len(set(names)) != len(names) or not all(isinstance(n, str) and n for n in [*names, *model["clinical"]]):
            raise ContractError("columns must be unique names")
        if not set(model["categories"]) <= set(model["clinical"]):
            raise ContractError("a category isn't a clinical column")
        made = {k: tuple(v) if isinstance(v, list) else v for k, v in model.items()}
        return cls(**made | {"categories": {k: tuple(v) for k, v in model["categories"].items()}}), names

    def column_sets(self, pet: list[str], t1: list[str], extra: str | None = None) -> dict[str, list[str]]:
        """C, CP, CPT and CT; extra is added to each."""
        more = [extra] if extra else []
        base = list(self.clinical)
        return {"C": base + more, "CP": base + pet + more, "CT": base + t1 + more, "CPT": base + pet + t1 + more}


def ablations(pet: list[str], drop: tuple[int, ...] = (0, 4)) -> dict[str, list[str]]:
    """The named columns without each of two, and without both."""
    return {"full": pet, **{f"without_{pet[k]}": [c for i, c in enumerate(pet) if i != k] for k in drop}, "without_both": [c for i, c in enumerate(pet) if i not in drop]}


#: Of a task: audit (training positions and coefficients) and candidates (each pair of the grid with its inner scores), in the first of its rows;
#: the largest differences from an independent fit in tested and training probabilities, and that of the objectives, in all.
RESULT = (
    "model string, repeat int, fold int, row_pos long, y int, p double, c double, l1 double, inner_brier double, kkt double, gap double, fits int, agreement double, train_agreement double, "
    "objective_difference double, status string, audit string, candidates array<struct<c:double,l1:double,brier:double,auc:double,briers:array<double>,aucs:array<double>>>"
)


def task_kernel(columns: dict[str, list[str]], binary: set[str], c_grid, l1_grid, unpenalized: set[str] = frozenset(), verify: bool = True, seconds: float = 3600):
    """The function of one task's rows: tune on inner parts by mean Brier score (ties within 1e-8: smaller C, then l1), refit, predict, audit.

    Rows are those of placed(), with values x in the order of the model's columns. Along the grid a fit begins from that of the
    C before it with the same l1; the one that is kept begins from nothing.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        began = time.monotonic()
        pdf = pdf.sort_values("row_pos", kind="stable")
        model, repeat, fold = pdf["model"].iloc[0], int(pdf["repeat"].iloc[0]), int(pdf["fold"].iloc[0])
        names = columns[model]
        kinds = np.array([c in binary for c in names])
        mask = np.array([c not in unpenalized for c in names])
        every, outcome = np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(int)
        fits_in, judged_in = pdf["fits_in"].to_numpy(np.int64), pdf["judged_in"].to_numpy(np.int64)
        part = lambda at: (every[at], outcome[at])
        train, test = pdf["trains"].to_numpy(bool), pdf["tests"].to_numpy(bool)
        where = pdf["row_pos"].to_numpy()
        base = {"model": model, "repeat": repeat, "fold": fold, "row_pos": where[test], "y": outcome[test]}
        try:
            grid, fits = {(c, l1): ([], []) for c in c_grid for l1 in l1_grid}, 0
            for k in range(int(np.bitwise_or.reduce(judged_in)).bit_length()):
                fitted, judged = fits_in >> k & 1 == 1, judged_in >> k & 1 == 1
                if not judged.any():
                    continue
                (x, y), (vx, vy) = part(fitted), part(judged)
                prep = elastic_net.prepare(x, kinds)
                x, vx = prep(x), prep(vx)
                m = mask[prep.keep] if not mask.all() else None
                for l1 in l1_grid:
                    last = None
                    for c in sorted(c_grid):
                        if time.monotonic() - began > seconds:
                            raise TimeoutError("the time for a task is over")
                        last = elastic_net.fit(x, y, c, l1, m, start=last)
                        p = last.probabilities(vx)
                        grid[c, l1][0].append(float(np.mean((p - vy) ** 2)))
                        grid[c, l1][1].append(float(linear.rank_auc(vy, p)))
                        fits += 1
            candidates = [{"c": c, "l1": l1, "brier": float(np.mean(b)), "auc": float(np.mean(a)), "briers": b, "aucs": a} for (c, l1), (b, a) in grid.items()]
            low = min(g["brier"] for g in candidates)
            best = min((g for g in candidates if g["brier"] <= low + 1e-8), key=lambda g: (g["c"], g["l1"]))
            score, c, l1 = best["brier"], best["c"], best["l1"]
            (x, y), (tx, _) = part(train), part(test)
            prep = elastic_net.prepare(x, kinds)
            x, tx = prep(x), prep(tx)
            m = mask[prep.keep] if not mask.all() else None
            final = elastic_net.fit(x, y, c, l1, m)
            p, told = final.probabilities(tx), dict.fromkeys(("agreement", "train_agreement", "objective_difference"))
            again = elastic_net.fit(x, y, c, l1, m)
            if not np.array_equal(again.coef, final.coef) or again.intercept != final.intercept:
                raise ArithmeticError("a repeated fit differs")
            if verify:
                other = elastic_net.proximal(x, y, c, l1, m)
                apart = [float(np.max(np.abs(other.probabilities(q) - final.probabilities(q)), initial=0.0)) for q in (tx, x)]
                told = dict(zip(told, [*apart, abs(other.objective - final.objective)]))
                if max(apart) > 1e-5 or told["objective_difference"] > 1e-10:
                    raise ArithmeticError(f"an independent fit differs by {max(apart):.3g}")
            audit = json.dumps({"train": where[train].tolist(), "dropped": [n for n, keep in zip(names, prep.keep) if not keep], "coefficients": dict(zip(np.array(names)[prep.keep].tolist(), final.coef.tolist())), "intercept": final.intercept})
            rest = [None] * (int(test.sum()) - 1)
            return pd.DataFrame(base | told | {"p": p, "c": c, "l1": l1, "inner_brier": score, "kkt": final.kkt, "gap": final.gap, "fits": fits + 1, "status": "PASS", "audit": [audit, *rest], "candidates": [candidates, *rest]})
        except (ValueError, ArithmeticError, TimeoutError) as e:
            none = {k: None for k in ("p", "c", "l1", "inner_brier", "kkt", "gap", "agreement", "train_agreement", "objective_difference", "audit", "candidates")}
            return pd.DataFrame(base | none | {"fits": 0, "status": f"{type(e).__name__}: {e}"})

    return run


def placed(plan: DataFrame) -> DataFrame:
    """repeat, fold, row_pos, trains, tests, fits_in, judged_in: one row for each of a plan's rows in an outer split.

    The last two have bit k set where the row is fitted or judged in inner fold k, so that a cohort's values meet a split
    once instead of once for each of its parts. Inner folds are numbered 0 to 62; a repeated row of the plan counts once.
    """
    inner, role = F.col("inner_fold"), F.col("role")
    bit = F.expr("shiftleft(1L, CAST(inner_fold AS INT))")
    bits = lambda r: F.coalesce(F.bit_or(F.when(role == r, required(inner.between(0, 62), bit, "inner folds are numbered 0 to 62"))), F.lit(0).cast("long"))
    outer = lambda r: F.coalesce(F.bool_or(inner.isNull() & (role == r)), F.lit(False))
    keys = [F.col("repeat").cast("int").alias("repeat"), F.col("fold").cast("int").alias("fold"), "row_pos"]
    return plan.groupBy(*keys).agg(outer("train").alias("trains"), outer("test").alias("tests"), bits("inner_train").alias("fits_in"), bits("validation").alias("judged_in"))


def run_nested(cohort: DataFrame, plan: DataFrame, columns: dict[str, list[str] | dict[str, str]], binary: set[str], settings: Settings = Settings(), unpenalized: set[str] = frozenset(), verify: bool = True) -> DataFrame:
    """RESULT rows of every model and outer test row. cohort: row_pos, y and numeric columns (categories as 0/1, gaps null); plan as in operators.splits.

    columns: a model's columns, or names of its columns with those of the cohort that they are taken from.
    """
    taken = {m: c if isinstance(c, dict) else {n: n for n in c} for m, c in columns.items()}
    gap = F.lit(float("nan"))
    models = [F.struct(F.lit(m).alias("model"), F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), gap) for c in t.values()]).alias("x")) for m, t in taken.items()]
    rows = placed(plan).join(cohort.select("row_pos", "y", F.array(*models).alias("_models")), "row_pos")
    tasks = rows.withColumn("_m", F.explode("_models")).select("repeat", "fold", "row_pos", "y", "trains", "tests", "fits_in", "judged_in", "_m.model", "_m.x")
    run = task_kernel({m: list(t) for m, t in taken.items()}, binary, settings.c_grid, settings.l1_grid, unpenalized, verify, settings.seconds)
    return tasks.groupBy("model", "repeat", "fold").applyInPandas(run, RESULT)


def run_ablations(cohort: DataFrame, plan: DataFrame, kept: list[str], removable: dict[str, list[str]], binary: set[str], settings: Settings = Settings(), draws: int = 2000, seed: int = 20260910, folder: str | None = None) -> dict[str, DataFrame]:
    """The full model and those without each of two groups of columns, and without both, all tuned again on the supplied plan.

    Tables: predictions, performance (of mean predictions), repeats, intervals and comparisons; a comparison is full less
    the other for both measures, its interval that of people drawn once for all models.
    """
    if len(removable) != 2 or not all(removable.values()):
        raise ContractError("two groups of columns are taken out")
    one, two = removable
    columns = {"full": [*kept, *removable[one], *removable[two]], f"without_{one}": [*kept, *removable[two]], f"without_{two}": [*kept, *removable[one]], "without_both": list(kept)}
    folder = folder or shared_folder(cohort.sparkSession, "ablations")
    cohort = written(cohort, "cohort")
    # the fits are dear: they are made once, and every table reads what they wrote
    run_nested(cohort, plan, columns, binary, settings).write.mode("overwrite").parquet(f"{folder}/predictions")
    got = results(cohort.sparkSession.read.schema(RESULT).parquet(f"{folder}/predictions"))
    people = cohort.select("row_pos", "y")
    mean = metrics.mean_predictions(got).join(people, "row_pos")
    drawn = resampling.weighted_metrics(mean, people, draws, seed)
    others = [m for m in columns if m != "full"]
    pairs = cohort.sparkSession.createDataFrame([(m, "full") for m in others], "base string, added string")
    intervals = resampling.difference_intervals(resampling.paired_differences(drawn, pairs, brier_sign=1))
    performance = metrics.measures(mean, "y", "p", ["model"])
    full, other = (performance.where(c).unpivot(["model"], ["auc", "brier"], "metric", "value") for c in (F.col("model") == "full", F.col("model") != "full"))
    seen = other.select(F.col("model").alias("base"), "metric", F.col("value").alias("_o")).join(full.select("metric", F.col("value").alias("_f")), "metric").select("base", "metric", (F.col("_f") - F.col("_o")).alias("difference"))
    return {"predictions": got, "performance": performance, "repeats": metrics.measures(got, "y", "p", ["model", "repeat"]), "intervals": resampling.model_intervals(drawn), "comparisons": seen.join(intervals.select("base", "metric", "lo", "hi"), ["base", "metric"], "left")}


def results(predictions: DataFrame) -> DataFrame:
    """predictions (written or cached before), if every task passed."""
    failed = predictions.where("status <> 'PASS'").select("model", "repeat", "fold", "status").distinct().limit(5).collect()
    if failed:
        raise ContractError(f"incomplete run: {[tuple(r) for r in failed]}")
    return predictions


DEVELOPMENT = "draw long, model string, bag_auc double, bag_brier double, original_auc double, original_brier double, oob_auc double, oob_brier double, people int, c double, l1 double, status string"


def development_bootstrap(weights: DataFrame, draws: int, cohort: DataFrame, columns: dict[str, list[str]], binary: set[str], settings: Settings = Settings()) -> DataFrame:
    """DEVELOPMENT rows: each draw tunes (inner folds by person, copies together) and refits each model, and is judged on its bag, on all rows and out of the bag.

    weights: draw (0 to draws - 1), row_pos, weight, how often a draw has a row; rows of weight 0 may be left out. A draw
    with fewer than three people of a class is recorded with its reason, not redrawn. The cohort meets the weights in
    one join, and a task has the rows of one draw.
    """
    needed = sorted({c for names in columns.values() for c in names})
    every = cohort.select("row_pos", "y", *[F.col(c).cast("double").alias(c) for c in needed]).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    rows = every.join(weights.select("draw", "row_pos", "weight"), ["draw", "row_pos"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))

    def one(draw: int, whole: pd.DataFrame, at: np.ndarray, model: str) -> dict:
        y_all = whole["y"].to_numpy(int)
        base = {"draw": draw, "model": model, "people": len(set(at))} | dict.fromkeys(("bag_auc", "bag_brier", "original_auc", "original_brier", "oob_auc", "oob_brier", "c", "l1"))
        names, began = columns[model], time.monotonic()
        kinds, x = np.array([c in binary for c in names]), whole[names].to_numpy(float)
        turn, fold = np.random.default_rng(settings.seed + 200_000 + draw), {}
        for label in (0, 1):
            people = np.array(sorted({a for a in at if y_all[a] == label}))
            if len(people) < settings.inner_folds:
                return base | {"status": "REJECTED_CLASS_SUPPORT"}
            fold |= {a: k % settings.inner_folds for k, a in enumerate(turn.permutation(people))}
        inner = np.array([fold[a] for a in at])
        best = None
        try:
            parts = []
            for k in range(settings.inner_folds):
                tr, va = at[inner != k], at[inner == k]
                prep = elastic_net.prepare(x[tr], kinds)
                parts.append((prep(x[tr]), y_all[tr], prep(x[va]), y_all[va]))
            grid = []
            for c in settings.c_grid:
                for l1 in settings.l1_grid:
                    if time.monotonic() - began > settings.seconds:
                        raise TimeoutError("the time for a task is over")
                    grid.append((float(np.mean([np.mean((elastic_net.fit(a, b, c, l1).probabilities(v) - w) ** 2) for a, b, v, w in parts])), c, l1))
            low = min(g[0] for g in grid)
            best = min((g for g in grid if g[0] <= low + 1e-8), key=lambda g: (g[1], g[2]))
            prep = elastic_net.prepare(x[at], kinds)
            p = elastic_net.fit(prep(x[at]), y_all[at], best[1], best[2]).probabilities(prep(x))
        except (ValueError, ArithmeticError, TimeoutError) as e:
            return base | {"status": f"{type(e).__name__}: {e}"}
        out = np.setdiff1d(np.arange(len(y_all)), at)
        score = lambda r: (linear.rank_auc(y_all[r], p[r]), float(np.mean((p[r] - y_all[r]) ** 2)) if len(r) else None)
        (ba, bb), (oa, ob), (xa, xb) = score(at), score(np.arange(len(y_all))), score(out)
        none = lambda v: None if v is None or np.isnan(v) else float(v)
        return base | {"bag_auc": none(ba), "bag_brier": bb, "original_auc": none(oa), "original_brier": ob, "oob_auc": none(xa), "oob_brier": xb, "c": best[1], "l1": best[2], "status": "PASS"}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_pos", kind="stable").reset_index(drop=True)
        at = np.repeat(np.arange(len(pdf)), pdf["weight"].to_numpy(int))
        return pd.DataFrame([one(int(pdf["draw"].iloc[0]), pdf, at, m) for m in columns])

    return rows.groupBy("draw").applyInPandas(run, DEVELOPMENT)
