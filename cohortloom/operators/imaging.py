"""Geometry checks, regional panels and tool invocations of the imaging steps. Invocations are rows; nothing is run."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import finite, required
from cohortloom.sources.workspace import written

#: Fixed values of the geometry checks.
SAME_GRID, VOXEL_SIZE, HEADER, IDENTITY = 1e-5, 1e-4, 1e-4, 1e-6


def integer_labels(label: Column) -> Column:
    """A label column as integers; fractions and non-finite values fail."""
    v = label.cast("double")
    return required(finite(v) & (v == F.rint(v)), v.cast("int"), "labels must be finite integers")


def same_grid(a: np.ndarray, b: np.ndarray, millimetres: float = 2.0) -> None:
    """Fails unless two images' affines agree and their voxels are cubes of the given size."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if a.shape != (4, 4) or np.abs(a - b).max() > SAME_GRID:
        raise ValueError("the images are on different grids")
    if np.abs(np.linalg.norm(a[:3, :3], axis=0) - millimetres).max() > VOXEL_SIZE:
        raise ValueError("the voxels have another size")


def header_geometry(pet: np.ndarray, anatomy: np.ndarray, segmentation: np.ndarray, pet_to_anatomy: tuple, segmentation_to_pet: tuple, anatomy_to_segmentation: tuple) -> dict:
    """Errors of transform files against image headers; each transform is (type, matrix)."""
    (k1, ras), (k2, vox), (k3, seg) = ((k, np.asarray(m, float)) for k, m in (pet_to_anatomy, segmentation_to_pet, anatomy_to_segmentation))
    voxel = float(np.abs(np.linalg.solve(pet, segmentation) - vox).max())
    want = np.linalg.solve(segmentation, anatomy) if k3 == 0 else np.eye(4)
    transform = float(np.abs(seg - want).max())
    if (k1, k2) != (1, 0) or k3 not in (0, 1) or np.abs(ras - np.eye(4)).max() > IDENTITY or voxel >= HEADER or transform >= HEADER:
        raise ValueError("the transforms don't fit the headers")
    return {"voxel_error": voxel, "transform_error": transform}


def panel(stats: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, regions: unilateral means in the order of pair name, then left and right; an absent mean fails.

    stats: by, label, mean; pairs: name, side, label.
    """
    rows = stats.select(*by).distinct().crossJoin(F.broadcast(pairs)).join(stats.select(*by, "label", "mean"), [*by, "label"], "left")
    rows = rows.withColumn("mean", required(F.col("mean").isNotNull(), F.col("mean"), "a region has no mean"))
    return rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("name", "side", "mean"))), lambda x: x["mean"]).alias("regions"))


def orientation(images: DataFrame) -> DataFrame:
    """images (affine: the 9 entries of a 3 x 3 matrix, row by row, world from voxel axes) with axes (the voxel axis closest to each
    world axis) and flips (whether it runs against it): of all six assignments that with the largest sum of absolute cosines, the
    first in order where two are equal. A voxel axis without length fails."""
    a = F.col("affine")
    size = [F.sqrt(sum((a[3 * w + v] * a[3 * w + v] for w in (1, 2)), a[v] * a[v])) for v in range(3)]
    cosine = lambda w, v: F.abs(a[3 * w + v]) / required(F.coalesce(size[v] > 0, F.lit(False)), size[v], "a voxel axis has no length")
    orders = list(permutations(range(3)))
    scored = [F.struct(F.round(cosine(0, o[0]) + cosine(1, o[1]) + cosine(2, o[2]), 9).alias("score"), F.lit(-k).alias("k"), F.array(*[F.lit(v) for v in o]).alias("axes")) for k, o in enumerate(orders)]
    best = images.withColumn("axes", F.greatest(*scored)["axes"])
    return best.withColumn("flips", F.array(*[F.element_at(a, F.lit(3 * w + 1) + F.col("axes")[w]) < 0 for w in range(3)]))


#: Images at most whose axes go to every task, and tasks over which the voxels of one of more images are dealt.
IMAGES, DEALT = 100_000, 32


def canonical(voxels: DataFrame, images: DataFrame, by: list[str]) -> DataFrame:
    """voxels with x, y, z: their places along the world's axes, which point right, forward and up.

    voxels: by, i, j, k from 0; images: by, affine, shape (voxels along i, j, k). A signed permutation of axes, so
    that nothing is resampled: values stay, and each voxel is a row of its own. A voxel outside its image fails.
    Voxels stay where they are and images go to them; of very many images, each one's voxels are dealt over DEALT tasks.
    """
    # counted first, as Spark can't tell how few they are
    turned = written(orientation(images).select(*by, "axes", "flips", "shape"), "images")
    if turned.limit(IMAGES + 1).count() <= IMAGES:
        met = voxels.join(F.broadcast(turned), by)
    else:
        copies = turned.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
        met = voxels.withColumn("_part", F.pmod(F.xxhash64("i", "j", "k"), F.lit(DEALT))).join(copies.hint("merge"), [*by, "_part"])
    place = F.array(*[F.col(c).cast("int") for c in "ijk"])
    inside = (F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("k") >= 0) & (F.col("i") < F.col("shape")[0]) & (F.col("j") < F.col("shape")[1]) & (F.col("k") < F.col("shape")[2])

    def along(w: int) -> Column:
        axis = F.col("axes")[w] + 1
        at = F.element_at(place, axis)
        return F.when(F.col("flips")[w], F.element_at("shape", axis).cast("int") - 1 - at).otherwise(at)

    first = required(F.coalesce(inside, F.lit(False)), along(0), "a voxel is outside its image")
    return met.select(*voxels.columns, first.alias("x"), along(1).alias("y"), along(2).alias("z"))


def bundle_residuals(products: DataFrame, cross: DataFrame, beta: DataFrame, by: list[str]) -> DataFrame:
    """by, i, residual: how far coefficients are from solving their normal equations, row by row, as one join and sum.

    products: by, i, j, v (entries that aren't there are 0); cross: by, i, v; beta: by, label, b. A product's column
    without a coefficient fails.
    """
    fits = products.join(beta.select(*by, F.col("label").alias("j"), "b"), [*by, "j"], "left")
    term = required(finite(F.col("b")), F.col("v") * F.col("b"), "a column has no coefficient")
    left = fits.groupBy(*by, "i").agg(F.sum(term).alias("_left"))
    return cross.join(left, [*by, "i"], "left").select(*by, "i", (F.coalesce("_left", F.lit(0.0)) - F.col("v")).alias("residual"))


def normal_equations(xtx: np.ndarray, xty: np.ndarray, beta: np.ndarray) -> dict:
    """How well coefficients solve their normal equations: relative residual, condition and largest difference from a solution."""
    xtx, xty, beta = (np.asarray(v, float) for v in (xtx, xty, beta))
    return {"residual": float(np.linalg.norm(xtx @ beta - xty) / np.linalg.norm(xty)), "condition": float(np.linalg.cond(xtx)), "difference": float(np.abs(np.linalg.solve(xtx, xty) - beta).max())}


def plain_argument(v: Column) -> Column:
    """A tool's argument: not empty, not an option, without control characters; else the query fails."""
    return required(F.coalesce((v != "") & ~v.startswith("-") & ~v.rlike(r"[\x00-\x1f]"), F.lit(False)), v, "not a plain argument")


def subject_name(v: Column) -> Column:
    return required(F.coalesce(v.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]*$"), F.lit(False)), v, "not a subject's name")


def invocations(subjects: DataFrame, step: str, parts: list[str | Column]) -> DataFrame:
    """subject, step, argv: one planned tool invocation for each subject; columns among the parts are checked arguments."""
    argv = [plain_argument(p) if isinstance(p, Column) else F.lit(p) for p in parts]
    return subjects.select(subject_name(F.col("subject")).alias("subject"), F.lit(step).alias("step"), F.array(*argv).alias("argv"))


def grid_step(subjects: DataFrame, threads: int = 4) -> DataFrame:
    """Planned registration of each subject's PET (columns subject, pet, t1, brainmask, transform) and its two-millimetre reference."""
    if not 1 <= threads <= 64:
        raise ValueError("threads must lie between 1 and 64")
    c = F.col
    coreg = invocations(subjects, "register", ["mri_coreg", "--mov", c("pet"), "--ref", c("t1"), "--ref-mask", c("brainmask"), "--reg", c("transform"), "--dof", "6", "--threads", str(threads)])
    grid = invocations(subjects, "grid", ["mri_convert", c("t1"), F.concat(c("subject"), F.lit("_reference.nii.gz")), "--voxsize", "2", "2", "2"])
    sample = invocations(subjects, "sample", ["mri_vol2vol", "--mov", c("pet"), "--targ", F.concat(c("subject"), F.lit("_reference.nii.gz")), "--lta", c("transform"), "--o", F.concat(c("subject"), F.lit("_pet.nii.gz")), "--trilin"])
    return coreg.unionByName(grid).unionByName(sample)


def overlay_counts(voxels: DataFrame, groups: DataFrame, axis: str, at: int, complete: bool = False) -> DataFrame:
    """group, voxels of a plane's labelled voxels; groups (label, group) that it doesn't meet count 0 or, if all must be met, fail."""
    plane = voxels.where(F.col(axis) == at).join(F.broadcast(groups), "label").groupBy("group").agg(F.count(F.lit(1)).alias("voxels"))
    return groups.select("group").distinct().join(plane, "group", "left").withColumn("voxels", required(F.col("voxels").isNotNull(), F.col("voxels"), "a group isn't on the plane") if complete else F.coalesce("voxels", F.lit(0)))


def bounding_boxes(voxels: DataFrame) -> DataFrame:
    """label and the lowest and highest i, j, k of its voxels."""
    return voxels.groupBy("label").agg(*[f(c).alias(f"{c}_{n}") for c in "ijk" for n, f in (("min", F.min), ("max", F.max))])
