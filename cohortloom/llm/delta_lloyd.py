"""Centroid clustering by delta Lloyd, in exact integers.

Vectors become integers, floor(scale * x). The table of assignments (vector,
owner, squared distance) is written in each round, and the global sums and
counts of the clusters, k * (dim + 1) integers, are all that the driver keeps.
Each round reads the last table once:

* a vector whose owner hasn't moved is compared with the centroids that have
  moved only, as its distances to the others are those of the last round;
* a vector whose owner has moved is compared with all;
* the vectors that change owner are summed in the task that reads them, with a
  minus sign for the cluster that they leave; these signed transfers, at most k
  rows a task, are written with the assignments in one atomic write, read by
  themselves (no vector is read for it), and added to the global sums.

Nothing is shuffled but transfers and the last sums of distances, so no cluster
is too large. A round in which no centroid moves ends the work: the rounds left
would change nothing.

Starting centroids are the k vectors with the smallest SHA-256 of salt + vec_id.

Defined results: vectors of another length, with a null or non-finite component,
or with a component beyond LARGEST after scaling (whose squared distances no
long holds) are left out; null vec_id: assigned like any other, never a start;
rows that repeat count as often as they are there, and of equal ids and vectors
each is a start of its own (the smaller number has all of them); ties go to the
smaller number; clusters without vectors keep their centroid; fewer vectors than
k give fewer clusters; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

DIM, K, ROUNDS, SCALE, SALT = 64, 40, 5, 256, "2:"
#: Components are at most this large, so that squared distances in 64 dimensions fit a long.
LARGEST = 1 << 27
#: Squared distances of components up to this are exact in doubles as well, which are multiplied faster.
EXACT_DOUBLE = 1 << 21
_BATCH = 8192


@dataclass
class Clustering:
    """assigned: vec_id, cluster, distance; centroids: k rows of integers."""

    assigned: DataFrame
    centroids: np.ndarray


def quantised(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their integers)."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())  # a null becomes NaN
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * flat.to_numpy(zero_copy_only=False).reshape(-1, dim))
        fine = (np.abs(x) <= LARGEST).all(axis=1)  # false for NaN and infinity
    return rows[fine], x[fine].astype(np.int64)


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of v to rows of c, exact."""
    kind = np.float64 if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT_DOUBLE else np.int64
    a, b = v.astype(kind), c.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


def nearest(v: np.ndarray, c: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, number) of each row's nearest centroid; numbers ascend, so that the first minimum is the smallest."""
    d = distances(v, c)
    at = d.argmin(axis=1)
    return d[np.arange(len(v)), at], numbers[at]


def reassigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) under centroids of which only those marked in moved differ from the ones before."""
    owner, distance = owner.copy(), distance.copy()
    changed, every = np.flatnonzero(moved), np.arange(len(centroids))
    lost = moved[owner]
    if lost.any():
        distance[lost], owner[lost] = nearest(v[lost], centroids, every)
    at = np.flatnonzero(~lost)
    if len(at) and len(changed):
        d, n = nearest(v[at], centroids[changed], changed)
        better = (d < distance[at]) | ((d == distance[at]) & (n < owner[at]))
        distance[at[better]], owner[at[better]] = d[better], n[better]
    return owner, distance


class _Transfers:
    """Signed sums and counts of the vectors that a task moves."""

    def __init__(self, k: int, dim: int):
        self.sums = np.zeros((k, dim + 1), np.int64)

    def move(self, v: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> None:
        one = np.concatenate((v, np.ones((len(v), 1), np.int64)), axis=1)
        if old is not None:
            change = old != new
            one, old, new = one[change], old[change], new[change]
            np.subtract.at(self.sums, old, one)
        np.add.at(self.sums, new, one)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        touched = np.flatnonzero(self.sums.any(axis=1))
        return touched, self.sums[touched]


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def _batch(ids: pa.Array, v: np.ndarray, owner: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    n = len(v)
    return pa.RecordBatch.from_arrays([ids, _lists(v, pa.int32()), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], ["vec_id", "v", "cluster", "distance", "transfer"])


def _transfer_batch(transfers: _Transfers, id_type: pa.DataType, dim: int) -> pa.RecordBatch:
    at, sums = transfers.rows()
    n = len(at)
    return pa.RecordBatch.from_arrays([pa.nulls(n, id_type), pa.nulls(n, pa.list_(pa.int32())), pa.array(at, pa.int32()), pa.nulls(n, pa.int64()), _lists(sums, pa.int64())], ["vec_id", "v", "cluster", "distance", "transfer"])


def starts(vectors: DataFrame, k: int, dim: int, scale: int, salt: str) -> np.ndarray:
    """The k kept vectors that start as centroids, in ascending order of their hashes."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = quantised(b.column(1), dim, scale)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), _lists(v, pa.int32())], ["vec_id", "v"])

    kept = vectors.where("vec_id is not null").mapInArrow(run, f"vec_id {id_type}, v array<int>")
    hashed = kept.select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in hashed.orderBy("h", "v").limit(k).collect()], np.int64).reshape(-1, dim)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT) -> Clustering:
    """Clusters the rows of vectors (vec_id, embedding); the assignments are those to the centroids after the last round."""
    spark = vectors.sparkSession
    folder = runtime.work_folder(spark, "lloyd")
    vectors = vectors.select(vectors["vec_id"].alias("vec_id"), vectors["embedding"].alias("embedding"))
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, v array<int>, cluster int, distance long, transfer array<long>"
    centroids = starts(vectors, k, dim, scale, salt)
    k = len(centroids)
    if not k:  # without one there is nothing that a vector could be assigned to
        return Clustering(spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long"), centroids)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transfers, kind = _Transfers(k, dim), None
        for b in batches:
            for at in range(0, b.num_rows, _BATCH):
                part = b.slice(at, _BATCH)
                rows, v = quantised(part.column(1), dim, scale)
                kind = part.column(0).type
                d, owner = nearest(v, centroids, np.arange(k))
                transfers.move(v, None, owner)
                yield _batch(part.column(0).take(pa.array(rows)), v, owner, d)
        if kind is not None:
            yield _transfer_batch(transfers, kind, dim)

    def again(now: np.ndarray, moved: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            transfers, kind = _Transfers(k, dim), None
            for b in batches:
                kind = b.column(0).type
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
                old, d = (b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
                owner, d = reassigned(v, old.astype(np.int64), d, now, moved)
                transfers.move(v, old, owner)
                yield _batch(b.column(0), v, owner, d)
            if kind is not None:
                yield _transfer_batch(transfers, kind, dim)

        return run

    sums = np.zeros((k, dim + 1), object)
    table = runtime.written(vectors.mapInArrow(first, schema), folder, "round0")
    for r in range(1, rounds + 1):
        sums = sums + _collected(table, k, dim)
        now = np.array([[int(x) // int(s[-1]) for x in s[:-1]] if s[-1] else list(c) for s, c in zip(sums, centroids)], np.int64)
        moved = (now != centroids).any(axis=1)
        if not moved.any():
            break
        centroids = now
        before = table.where("v is not null").select("vec_id", "v", "cluster", "distance")
        table = runtime.written(before.mapInArrow(again(now, moved), schema), folder, f"round{r}")
        runtime.delete_folder(spark, f"{folder}/round{r - 1}")
    return Clustering(table.where("v is not null").select("vec_id", "cluster", "distance"), centroids)


def _collected(table: DataFrame, k: int, dim: int) -> np.ndarray:
    """The sum of all transfers of a round: k * (dim + 1) integers, whatever the number of vectors."""
    out = np.zeros((k, dim + 1), object)
    rows = table.where("transfer is not null").select("cluster", F.posexplode("transfer")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    for c, pos, total in rows.collect():
        out[c, pos] = int(total)
    return out


def with_inertia(found: Clustering) -> DataFrame:
    """assigned with cluster_inertia, inertia (sums of distances) and centroid_sha256 of its cluster."""
    spark = found.assigned.sparkSession
    per = {r[0]: int(r[1]) for r in found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows at most
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    rows = [(c, n, sum(per.values()), names[c]) for c, n in per.items()]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(told), "cluster")
