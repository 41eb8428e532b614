"""Operator 12 against plain Lloyd rounds in Python's integers."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import delta_lloyd, queries

SCHEMA = "vec_id long, embedding array<double>, cluster int, v string, transfer string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 7, "x", "y") for i, e in rows], SCHEMA)


def brute(rows, k, rounds, dim, scale=256):
    """(sorted (vec_id, cluster, distance), centroids)."""
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    c = [v for _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), n) for n, m in enumerate(c))
    for _ in range(rounds):
        owner = [nearest(v)[1] for _, v in kept]
        for n in range(len(c)):
            own = [v for (_, v), o in zip(kept, owner) if o == n]
            if own:
                c[n] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, *reversed(nearest(v))) for i, v in kept), key=str) if c else [], c


def found(result):
    return sorted(((r.vec_id, r.cluster, r.distance) for r in result.assigned.collect()), key=str)


def vectors(seed, n, dim, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), (rng.normal(size=dim) * spread + rng.integers(0, 4)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "dim", "k", "rounds", "spread"), [(120, 3, 7, 6, 1.0), (90, 8, 5, 1, 1.0), (60, 2, 12, 5, 0.004), (40, 2, 3, 40, 1.0), (50, 4, 4, 3, 1e5)])
def test_equals_plain_rounds(spark, n, dim, k, rounds, spread):
    rows = vectors(n, n, dim, spread)
    got = delta_lloyd.cluster(table(spark, rows).repartition(3), k, rounds, dim)
    want, centroids = brute(rows, k, rounds, dim)
    assert found(got) == want
    assert got.centroids.tolist() == centroids


def test_defined_results_of_awkward_rows(spark):
    good = vectors(5, 30, 4)
    rows = good + [good[3], good[3], (None, [0.5] * 4), (None, None), (70, None), (71, []), (72, [1.0] * 3), (73, [1.0] * 5), (74, [1.0, None, 1.0, 1.0]), (75, [math.nan, 1.0, 1.0, 1.0]), (76, [math.inf, 1.0, 1.0, 1.0])]
    got = delta_lloyd.cluster(table(spark, [*rows, (77, [1e6, 0.0, 0.0, 0.0])]), 6, 4, 4)
    want, centroids = brute(rows, 6, 4, 4)
    assert found(got) == want  # 77 is beyond LARGEST
    assert got.centroids.tolist() == centroids
    assert found(delta_lloyd.cluster(table(spark, good[:3]), 6, 4, 4)) == brute(good[:3], 6, 4, 4)[0]
    nothing = delta_lloyd.with_inertia(delta_lloyd.cluster(table(spark, []), 6, 4, 4))
    assert nothing.count() == 0 and "centroid_sha256" in nothing.columns
    assert delta_lloyd.cluster(table(spark, [(None, [0.5] * 4)]), 6, 4, 4).assigned.count() == 0
    floats = table(spark, good).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    assert delta_lloyd.cluster(floats, 6, 4, 4).assigned.count() == len(good)


def test_only_changed_centroids_and_lost_owners_are_compared(spark, monkeypatch):
    """A round's owners and distances are those of all comparisons, though most are left out."""
    rng = np.random.default_rng(1)
    v, before = rng.integers(-50, 50, (400, 6)), rng.integers(-50, 50, (9, 6))
    d, owner = delta_lloyd.nearest(v, before, np.arange(9))
    after = before.copy()
    after[[2, 5]] += rng.integers(-9, 9, (2, 6))
    moved = (after != before).any(axis=1)
    seen = []
    plain = delta_lloyd.distances
    monkeypatch.setattr(delta_lloyd, "distances", lambda a, b: seen.append(len(a) * len(b)) or plain(a, b))
    got_owner, got_distance = delta_lloyd.reassigned(v, owner, d, after, moved)
    lost = int(moved[owner].sum())
    assert sum(seen) == lost * 9 + (400 - lost) * 2 < 400 * 9
    want = plain(v, after)
    assert (got_owner == want.argmin(axis=1)).all() and (got_distance == want.min(axis=1)).all()


def test_transfers_add_up():
    v = np.arange(12).reshape(4, 3)
    t = delta_lloyd._Transfers(5, 3)
    t.move(v, None, np.array([0, 0, 1, 4]))
    t.move(v, np.array([0, 0, 1, 4]), np.array([0, 2, 1, 2]))
    assert t.sums[:, -1].tolist() == [1, 1, 2, 0, 0]
    assert t.sums[2, :3].tolist() == (v[1] + v[3]).tolist() and not t.sums[4].any()
    assert t.rows()[0].tolist() == [0, 1, 2]


def test_large_components_are_exact():
    v = np.array([[1 << 27, -(1 << 27)] * 32, [(1 << 27) - 1] * 64])
    c = np.array([[-(1 << 27)] * 64, [1 << 27] * 64])
    assert delta_lloyd.distances(v, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_agrees_with_its_sql(spark, scale):
    import duckdb

    folder = f"/root/testdata/{scale}"
    got = queries.op12_delta_lloyd(spark, folder)
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op12_delta_lloyd']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
