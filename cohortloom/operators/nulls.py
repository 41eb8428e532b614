"""Spatial null maps that executors make and judge where they are: only statistics leave a task.

A null map is offset + sum over components of sign x component, so that all that
goes along with the tasks is one parcels x components matrix, of an atlas whose
size is fixed and checked. Signs and rotations of a draw come from a generator
keyed by the seed and the draw's number: any task can make any draw, and a draw
that is made again is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cohortloom.operators import pattern
from cohortloom.operators.linear import ranks, residuals

#: Parcels of an atlas at most: its components are 32 MB then.
PARCELS = 2048
#: Draws of which a task makes maps at once.
GULP = 256


@dataclass
class Plan:
    """What null maps of an observed map are made of, and what stays the same in all of them."""

    observed: np.ndarray
    offset: np.ndarray
    components: np.ndarray
    #: name: (positions, weights) of graphs whose Moran's I is told
    graphs: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    nuisance: np.ndarray | None = None

    def __post_init__(self) -> None:
        if len(self.observed) > PARCELS:
            raise ValueError(f"an atlas has at most {PARCELS} parcels")


def hemispheres(x: np.ndarray, w: np.ndarray, graphs: dict | None = None) -> Plan:
    """Random signs, the same in both halves, of each half's spectrum on one half's graph: means, norms and Moran's I stay."""
    n = len(w)
    basis, both = pattern.spectral_basis(w), np.column_stack([x[:n], x[n:]])
    mean = both.mean(axis=0)
    spectrum = basis.T @ (both - mean)
    return Plan(x, np.repeat(mean, n), np.vstack([basis * spectrum[:, 0], basis * spectrum[:, 1]]), graphs or {"right": (np.arange(n), w), "left": (np.arange(n, 2 * n), w)})


def conditional(x: np.ndarray, design: np.ndarray, w: np.ndarray, graphs: dict | None = None) -> Plan:
    """Random signs of the spectrum of the ranks' residual on a design, in the space orthogonal to it: norm, Moran's I on the whole
    graph and orthogonality to the design stay."""
    e = residuals(ranks(x), design)
    if np.linalg.norm(e) <= 1e-10:
        raise pattern.Degenerate("the design leaves nothing of the map")
    basis = pattern.spectral_basis(w, design)
    return Plan(e, np.zeros(len(e)), basis * (basis.T @ e), graphs or {"global": (np.arange(len(e)), w)}, design)


def _unit(maps: np.ndarray) -> np.ndarray:
    """Rows centred and of length 1, or NaN where there is no spread."""
    z = maps - maps.mean(axis=1, keepdims=True)
    size = np.sqrt((z * z).sum(axis=1, keepdims=True))
    return np.where(size > 1e-14, z / np.where(size > 1e-14, size, 1), np.nan)


def correlations(maps: np.ndarray, targets: np.ndarray, hard: bool = True) -> np.ndarray:
    """maps x targets: Pearson correlations within -1 and 1. hard: a map or target without spread is an error; else NaN."""
    r = np.clip(_unit(np.atleast_2d(maps)) @ _unit(np.atleast_2d(targets.T)).T, -1, 1)
    if hard and not np.isfinite(r).all():
        raise pattern.Degenerate("a map or a target has no spread")
    return r


def signs(draws: np.ndarray, m: int, seed: int) -> np.ndarray:
    """draws x m of -1 and 1; a draw's row depends on its number and the seed alone."""
    return np.stack([np.random.Generator(np.random.Philox(key=np.array([seed, d], np.uint64))).integers(0, 2, m) for d in draws.tolist()]) * 2.0 - 1


def maps_of(plan: Plan, draws: np.ndarray, seed: int) -> np.ndarray:
    return plan.offset + signs(draws, plan.components.shape[1], seed) @ plan.components.T


NULL = "draw long, r array<double>, norm2 double, moran array<double>, nuisance double, cosine double"


def _told(maps: np.ndarray, plan: Plan, targets: np.ndarray) -> list[pa.Array]:
    half = maps.shape[1] // 2
    rows = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))
    moran = np.stack([pattern.moran(maps[:, at], w) for at, w in plan.graphs.values()], axis=1) if plan.graphs else np.zeros((len(maps), 0))
    dot = np.abs(maps @ plan.nuisance).max(axis=1) if plan.nuisance is not None else np.zeros(len(maps))
    a, b = maps[:, :half], maps[:, half : 2 * half]
    size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return [rows(correlations(maps, targets)), pa.array((maps * maps).sum(axis=1)), rows(moran), pa.array(dot), pa.array((a * b).sum(axis=1) / np.where(size > 0, size, np.nan))]


def null_statistics(spark: SparkSession, plan: Plan, targets: np.ndarray, draws: int, seed: int) -> DataFrame:
    """NULL rows: correlations with each target (columns), squared norm, Moran's I on each graph, largest product with the nuisance
    design, cosine of the halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, GULP):
                d = b.column(0).slice(k, GULP)
                yield pa.RecordBatch.from_arrays([d, *_told(maps_of(plan, d.to_numpy(), seed), plan, targets)], ["draw", "r", "norm2", "moran", "nuisance", "cosine"])

    return spark.range(draws).mapInArrow(run, NULL)


def observed_statistics(plan: Plan, targets: np.ndarray) -> dict:
    """The same of the observed map."""
    told = [x.to_pylist()[0] for x in _told(plan.observed[None, :], plan, targets)]
    return dict(zip(("r", "norm2", "moran", "nuisance", "cosine"), told))


def rotation(draw: int, seed: int) -> np.ndarray:
    """A uniform rotation from the quaternion of four normal deviates."""
    x, y, z, w = (q := np.random.Generator(np.random.Philox(key=np.array([seed, draw], np.uint64))).normal(size=4)) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def spin(coords: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The permutation of one rotation: the left half by it, the right half by its mirror image, parcels assigned one to one."""
    n, mirror = len(coords) // 2, np.diag([-1.0, 1.0, 1.0])
    perm = np.empty(2 * n, int)
    for at, t in ((np.arange(n, 2 * n), turn), (np.arange(n), mirror @ turn @ mirror)):
        gap = coords[at][:, None, :] - (coords[at] @ t)[None, :, :]
        perm[at] = at[pattern.assign(np.sqrt((gap * gap).sum(axis=2)))]
    return perm


def spin_statistics(spark: SparkSession, coords: np.ndarray, x: np.ndarray, targets: np.ndarray, draws: int, seed: int, tasks: int) -> DataFrame:
    """draw, r (of the spun map with each target), identity, valid (the permutation has each parcel once and stays in its hemisphere)."""
    if len(coords) > PARCELS:
        raise ValueError(f"an atlas has at most {PARCELS} parcels")
    n, every = len(coords) // 2, np.arange(len(coords))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            perms = np.stack([spin(coords, rotation(d, seed)) for d in b.column(0).to_pylist()]) if b.num_rows else np.zeros((0, 2 * n), int)
            r = correlations(x[perms], targets) if len(perms) else np.zeros((0, targets.shape[1]))
            valid = (np.sort(perms, axis=1) == every).all(axis=1) & (perms[:, :n] < n).all(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(r.tolist(), pa.list_(pa.float64())), pa.array((perms == every).all(axis=1)), pa.array(valid)], ["draw", "r", "identity", "valid"])

    return spark.range(0, draws, 1, tasks).mapInArrow(run, "draw long, r array<double>, identity boolean, valid boolean")
