"""Voxel tables on the world's axes and residuals of normal equations, against NumPy."""

from itertools import permutations

import numpy as np
import pytest

from cohortloom.operators import imaging

SHAPE = (3, 4, 2)


def test_all_orientations_equal_transposed_and_flipped_arrays(spark):
    volume = np.arange(24).reshape(SHAPE)
    voxels, images, want = [], [], {}
    for m in range(48):
        order, signs = list(permutations(range(3)))[m // 8], [-1 if m % 8 & 1 << w else 1 for w in range(3)]
        affine = np.zeros((3, 3))
        for w in range(3):
            affine[w, order[w]] = signs[w] * (w + 1.5)
        affine += 0.05 * np.arange(9).reshape(3, 3) / 9
        images.append((m, affine.ravel().tolist(), list(SHAPE)))
        voxels += [(m, *map(int, at), int(volume[at])) for at in np.ndindex(SHAPE)]
        turned = volume.transpose(order)
        want[m] = turned[tuple(slice(None, None, s) for s in signs)]
    got = imaging.canonical(spark.createDataFrame(voxels, "image int, i int, j int, k int, value int"), spark.createDataFrame(images, "image int, affine array<double>, shape array<int>"), ["image"]).collect()
    assert len(got) == 48 * 24
    for r in got:
        assert want[r.image][r.x, r.y, r.z] == r.value


def test_voxels_outside_and_flat_axes_fail(spark):
    images = spark.createDataFrame([(1, np.eye(3).ravel().tolist(), [2, 2, 2])], "image int, affine array<double>, shape array<int>")
    one = lambda i: spark.createDataFrame([(1, i, 0, 0)], "image int, i int, j int, k int")
    assert imaging.canonical(one(1), images, ["image"]).first().x == 1
    for i in (2, -1):
        with pytest.raises(Exception, match="outside"):
            imaging.canonical(one(i), images, ["image"]).collect()
    flat = spark.createDataFrame([(1, np.diag([1.0, 1.0, 0.0]).ravel().tolist(), [2, 2, 2])], "image int, affine array<double>, shape array<int>")
    with pytest.raises(Exception, match="no length"):
        imaging.canonical(one(0), flat, ["image"]).collect()


def test_residuals_of_a_bundle(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6))
    xtx, b = x.T @ x, rng.normal(size=6)
    xty = xtx @ b + np.array([0, 0, 0.5, 0, 0, 0])
    products = spark.createDataFrame([("s", i, j, float(xtx[i, j])) for i in range(6) for j in range(6)], "subject string, i int, j int, v double")
    cross = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(xty)], "subject string, i int, v double")
    beta = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(b)], "subject string, label int, b double")
    got = {r.i: r.residual for r in imaging.bundle_residuals(products, cross, beta, ["subject"]).collect()}
    assert [got[k] for k in range(6)] == pytest.approx((xtx @ b - xty).tolist(), abs=1e-9)
    with pytest.raises(Exception, match="no coefficient"):
        imaging.bundle_residuals(products, cross, beta.where("label < 5"), ["subject"]).collect()


@pytest.mark.parametrize("most", [100_000, 1])
def test_voxels_of_an_image_are_not_one_task(spark, monkeypatch, most):
    """Few images go to the voxels; of many, each one's voxels are dealt over several tasks."""
    monkeypatch.setattr(imaging, "IMAGES", most)
    images = spark.createDataFrame([(m, np.eye(3).ravel().tolist(), [40, 40, 40]) for m in (1, 2)], "image int, affine array<double>, shape array<int>")
    voxels = spark.createDataFrame([(1, n % 40, n // 40, 3) for n in range(40 * 40)], "image int, i int, j int, k int")
    got = imaging.canonical(voxels, images, ["image"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (most > 1) and ("SortMergeJoin" in plan and "_part" in plan) == (most == 1)
    rows = got.collect()
    assert len(rows) == 1600 and all((r.x, r.y, r.z) == (r.i, r.j, r.k) for r in rows)
