"""Compositional principal components and spatial nulls: NumPy kernels, and their distribution over draws."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Degenerate(ValueError):
    """Data without between-row variance."""


def first_component(x: np.ndarray) -> dict:
    """Covariance PCA by SVD, without scaling: loading, scores, two eigenvalues, explained share, near tie."""
    x = np.asarray(x, float)
    centre = x.mean(axis=0)
    z = x - centre
    if (z * z).sum() <= np.finfo(float).eps * max((x * x).sum(), np.finfo(float).tiny):
        raise Degenerate("no variance between rows")
    s, vt = np.linalg.svd(z, full_matrices=False)[1:]
    e = s * s / (len(x) - 1)
    return {"centre": centre, "loading": vt[0], "scores": z @ vt[0], "eigen1": float(e[0]), "eigen2": float(e[1]), "explained": float(e[0] / e.sum()), "near_tie": bool(e[0] - e[1] <= 1e-10 * e[0])}


def moments(rows: DataFrame, column: str) -> tuple[float, np.ndarray, np.ndarray]:
    """(number, sum, sum of outer products) of a column of equally long arrays: a bounded number of figures reaches the driver."""

    def run(batches):
        n = total = products = None
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), float)
                add = (len(x), x.sum(axis=0), x.T @ x)
                n, total, products = add if n is None else (n + add[0], total + add[1], products + add[2])
        if n:
            k = len(total)
            at = np.arange(k)
            i = np.concatenate(([-2], np.full(k, -1), np.repeat(at, k)))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.concatenate(([0], at, np.tile(at, k)))), pa.array(np.concatenate(([n], total, products.ravel())).astype(float))], ["i", "j", "v"])

    found = rows.select(column).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    k = sum(r.i == -1 for r in found)
    n, total, products = 0.0, np.zeros(k), np.zeros((k, k))
    for i, j, v in found:
        if i == -2:
            n = v
        elif i == -1:
            total[j] = v
        else:
            products[i, j] = v
    return n, total, products


def component_of_moments(n: float, total: np.ndarray, products: np.ndarray) -> dict:
    """first_component() without scores, from moments() of the rows."""
    centre = total / n
    cov = (products - n * np.outer(centre, centre)) / (n - 1)
    if np.trace(cov) * (n - 1) <= np.finfo(float).eps * max(np.trace(products), np.finfo(float).tiny):
        raise Degenerate("no variance between rows")
    e, v = np.linalg.eigh(cov)
    return {"centre": centre, "loading": v[:, -1], "eigen1": float(e[-1]), "eigen2": float(e[-2]), "explained": float(e[-1] / e.sum())}


def sign_by_largest(loading: np.ndarray) -> float:
    """The sign that makes the largest absolute entry positive."""
    return -1.0 if loading[np.argmax(np.abs(loading))] < 0 else 1.0


def sign_by_anchor(loading: np.ndarray, names: list[str], anchors: tuple[str, str]) -> tuple[float, str]:
    """The sign that makes the anchors' mean positive; where that is 0 each anchor in turn, then the largest entry, ties by name."""
    at = [names.index(a) for a in anchors]
    for value, rule in ((float(np.mean(loading[at])), "mean"), *((float(loading[k]), names[k]) for k in at)):
        if abs(value) > 1e-12:
            return (-1.0 if value < 0 else 1.0), rule
    top = np.flatnonzero(np.abs(loading) == np.abs(loading).max())
    k = min(top, key=lambda i: names[i])
    return (-1.0 if loading[k] < 0 else 1.0), names[k]


def components_without(z: np.ndarray, design: np.ndarray | None, k: int) -> np.ndarray:
    """k loadings of z less its least-squares fit on a design, signs by the largest entry."""
    if design is not None:
        z = z - design @ np.linalg.lstsq(design, z, rcond=None)[0]
    v = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)[2][:k]
    return v * np.array([sign_by_largest(r) for r in v])[:, None]


def best_match(a: np.ndarray, b: np.ndarray) -> dict:
    """Absolute cosines of two small sets of unit rows: of equal index, of the best one-to-one match, of the subspaces."""
    c = np.abs(a @ b.T)
    best = max(permutations(range(len(b))), key=lambda p: c[range(len(a)), list(p)].sum())
    return {"same": c.diagonal().tolist(), "match": list(best), "matched": c[range(len(a)), list(best)].tolist(), "subspace": float((c * c).sum() / len(a))}


def bootstrap_components(spark: SparkSession, x: np.ndarray, loading: np.ndarray, indices: np.ndarray, tasks: int = 8) -> DataFrame:
    """draw, loading, eigen1, eigen2, explained, cosine, near_tie, ambiguous, degenerate for each row of indices.

    x is one cohort's matrix and goes along with the tasks; draws are dealt over them. Degenerate draws stay, as nulls.
    """
    x, loading = np.asarray(x, float), np.asarray(loading, float)

    def run(batches):
        for b in batches:
            rows = []
            for draw, ix in zip(b["draw"], b["ix"]):
                try:
                    f = first_component(x[np.asarray(ix)])
                except Degenerate:
                    rows.append((draw, None, None, None, None, None, None, None, True))
                    continue
                dot = float(f["loading"] @ loading)
                rows.append((draw, (f["loading"] * (-1 if dot < 0 else 1)).tolist(), f["eigen1"], f["eigen2"], f["explained"], abs(dot) / float(np.linalg.norm(loading)), f["near_tie"], abs(dot) <= 1e-12, False))
            yield pd.DataFrame(rows, columns=["draw", "loading", "eigen1", "eigen2", "explained", "cosine", "near_tie", "ambiguous", "degenerate"])

    draws = spark.createDataFrame(pd.DataFrame({"draw": np.arange(len(indices)), "ix": list(map(list, indices.tolist()))}), "draw long, ix array<long>").repartition(tasks, "draw")
    return draws.mapInPandas(run, "draw long, loading array<double>, eigen1 double, eigen2 double, explained double, cosine double, near_tie boolean, ambiguous boolean, degenerate boolean")


def stratified_indices(strata: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Row indices drawn with replacement within each stratum, strata in order."""
    turn = np.random.default_rng(seed)
    out = np.empty((draws, len(strata)), np.int64)
    for b in range(draws):
        for s in sorted(set(strata)):
            at = np.flatnonzero(strata == s)
            out[b, at] = turn.choice(at, len(at))
    return out


def helmert(n: int) -> np.ndarray:
    """n x (n - 1): orthonormal columns, each of sum 0."""
    h = np.triu(np.ones((n, n - 1)))
    k = np.arange(1, n)
    h[k, k - 1] = -k
    return h / np.sqrt(k * (k + 1.0))


def moran(maps: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = np.atleast_2d(maps)
    z = z - z.mean(axis=1, keepdims=True)
    ss = (z * z).sum(axis=1)
    return np.where(ss > 1e-28, len(w) / w.sum() * ((z @ w) * z).sum(axis=1) / np.where(ss > 1e-28, ss, 1), np.nan)


def spectral_basis(w: np.ndarray, null: np.ndarray | None = None) -> np.ndarray:
    """Orthonormal eigenvectors of a graph's weights within the space of sum 0, or orthogonal to the columns of null."""
    q = helmert(len(w)) if null is None else np.linalg.qr(null, mode="complete")[0][:, np.linalg.matrix_rank(null) :]
    return q @ np.linalg.eigh(q.T @ w @ q)[1]


def hemisphere_nulls(x: np.ndarray, w: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Maps of two hemispheres (halves of x) with the same random signs of their spectra: means, norms, Morans and the product of halves stay."""
    n = len(w)
    basis = spectral_basis(w)
    both = np.column_stack([x[:n], x[n:]])
    mean = both.mean(axis=0)
    spectrum = basis.T @ (both - mean)
    out = np.einsum("ij,bj,jk->bki", basis, signs, spectrum) + mean[None, :, None]
    return out.reshape(len(signs), 2 * n)


def conditional_nulls(x: np.ndarray, design: np.ndarray, w: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(residual of x, maps): random signs of its spectrum in the space orthogonal to the design."""
    basis = spectral_basis(w, design)
    e = x - design @ np.linalg.lstsq(design, x, rcond=None)[0]
    return e, (signs * (basis.T @ e)) @ basis.T


def random_signs(draws: int, n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).choice([-1.0, 1.0], size=(draws, n))


def random_rotations(draws: int, seed: int) -> np.ndarray:
    """Uniform rotations from unit quaternions of normal deviates."""
    q = np.random.Generator(np.random.PCG64(seed)).normal(size=(draws, 4))
    x, y, z, w = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    return np.stack([np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], -1), np.stack([2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], -1), np.stack([2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], -1)], 1)


def assign(cost: np.ndarray) -> np.ndarray:
    """For each row the column of the cheapest one-to-one assignment: shortest augmenting paths with potentials."""
    n = len(cost)
    u, v, owner = np.zeros(n), np.zeros(n + 1), np.full(n + 1, -1)
    for row in range(n):
        owner[n], at = row, n
        dist, back, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            free = ~done[:n]
            slack = cost[owner[at]] - u[owner[at]] - v[:n]
            nearer = free & (slack < dist)
            dist[nearer], back[nearer] = slack[nearer], at
            nxt = int(np.argmin(np.where(free, dist, np.inf)))
            step = dist[nxt]
            u[owner[done]] += step
            v[done] -= step
            dist[free] -= step
            at = nxt
        while at != n:
            owner[at], at = owner[back[at]], back[at]
    out = np.empty(n, int)
    out[owner[:n]] = np.arange(n)
    return out


def spins(spark: SparkSession, coords: np.ndarray, draws: int, seed: int, tasks: int = 8) -> DataFrame:
    """draw, perm: rotations of one sphere and their mirror images of the other, each hemisphere's parcels assigned one to one.

    coords: right half, then left half, of a small atlas, which goes along with the tasks.
    """
    coords = np.asarray(coords, float)
    n, mirror = len(coords) // 2, np.diag([-1.0, 1.0, 1.0])
    turns = random_rotations(draws, seed)

    def run(batches):
        for b in batches:
            perms = []
            for draw in b["draw"]:
                perm = np.empty(2 * n, int)
                for at, turn in ((np.arange(n, 2 * n), turns[draw]), (np.arange(n), mirror @ turns[draw] @ mirror)):
                    gap = coords[at][:, None, :] - (coords[at] @ turn)[None, :, :]
                    perm[at] = at[assign(np.sqrt((gap * gap).sum(axis=2)))]
                perms.append(perm.tolist())
            yield pd.DataFrame({"draw": b["draw"], "perm": perms})

    return spark.range(draws).withColumnRenamed("id", "draw").repartition(tasks, "draw").mapInPandas(run, "draw long, perm array<int>")


def nuisance(gradients: np.ndarray, right: int) -> np.ndarray:
    """1, hemisphere, and the standardized ranks of each gradient; full rank is required."""
    from cohortloom.operators.linear import ranks

    r = ranks(gradients)
    n = len(r)
    z = np.column_stack([np.ones(n), np.arange(n) < right, (r - r.mean(axis=0)) / r.std(axis=0)])
    if np.linalg.matrix_rank(z) < z.shape[1]:
        raise ValueError("the nuisance design lacks rank")
    return z


def retained(x: np.ndarray, design: np.ndarray) -> dict:
    """Share of a ranked map's variance that a design leaves, and its variance inflation."""
    from cohortloom.operators.linear import ranks, residuals

    r = ranks(x)
    e = residuals(r, design)
    share = float((e @ e) / np.sum((r - r.mean()) ** 2))
    return {"retained": share, "vif": 1 / share if share else float("inf")}
