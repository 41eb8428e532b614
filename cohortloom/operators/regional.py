"""Regional features from labelled measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import finite, required
from cohortloom.operators.metrics import _joined
from cohortloom.operators.quantiles import quantiles

#: Fixed values of the region rules.
HARD_MINIMUM, ATTENTION_MAXIMUM, VALID_PASS, VALID_ATTENTION, COVERAGE = 10, 24, 0.95, 0.80, 0.95


def reference_means(voxels: DataFrame, masks: dict[str, Column], by: list[str], value: str = "pet", brain: str = "brainmask") -> DataFrame:
    """For each group: mean and count of each named mask within the brain (finite zeros count), and the share of positive
    values in the brain. A negative or non-finite value fails."""
    v = required(finite(F.col(value)) & (F.col(value) >= 0), F.col(value).cast("double"), "values must be finite and not negative")
    df = voxels.withColumn("_v", v)
    inside = F.col(brain) > 0
    cells = [x for name, m in masks.items() for x in (F.avg(F.when(m & inside, F.col("_v"))).alias(f"{name}_mean"), F.count_if(m & inside).alias(f"{name}_count"))]
    return df.groupBy(*by).agg(*cells, F.avg(F.when(inside, (F.col("_v") > 0).cast("double"))).alias("positive_share"))


def reference_gate(references: DataFrame, minimum: dict[str, int]) -> DataFrame:
    """references with passed: every mean positive, every count enough, and coverage of at least COVERAGE."""
    ok = F.coalesce(F.col("positive_share"), F.lit(0.0)) >= COVERAGE
    for name, n in minimum.items():
        ok = ok & (F.coalesce(F.col(f"{name}_mean"), F.lit(0.0)) > 0) & (F.col(f"{name}_count") >= n)
    return references.withColumn("passed", ok)


def normalized(voxels: DataFrame, references: DataFrame, reference: str, by: list[str], value: str = "pet") -> DataFrame:
    """voxels with normalized (float): value over its group's reference mean, which must be positive."""
    mean = references.select(*by, required(F.coalesce(F.col(f"{reference}_mean") > 0, F.lit(False)), F.col(f"{reference}_mean"), "the reference is empty or not positive").alias("_mean"))
    return voxels.join(mean, by).withColumn("normalized", (F.col(value) / F.col("_mean")).cast("float")).drop("_mean")


def _state(count: Column, share: Column) -> Column:
    return (
        F.when(count < HARD_MINIMUM, "missing_label_below_hard_minimum")
        .when(share < VALID_ATTENTION, "missing_insufficient_valid_pet_fraction")
        .when(count <= ATTENTION_MAXIMUM, "attention_low_label_voxels")
        .when(share < VALID_PASS, "attention_valid_pet_fraction")
        .otherwise("pass")
    )


def region_stats(voxels: DataFrame, by: list[str], value: str = "pet", with_median: bool = True) -> DataFrame:
    """For each group: label_voxels, valid_voxels (finite and above zero), valid_fraction, mean, median, status.

    The exact median comes by selection, in two passes more; without it all is combined map-side.
    """
    v = F.col(value).cast("double")
    valid = F.when(finite(v) & (v > 0), v)
    cells = [F.count(F.lit(1)).alias("label_voxels"), F.count(valid).alias("valid_voxels"), F.avg(valid).alias("mean")]
    out = voxels.groupBy(*by).agg(*cells)
    if with_median:
        out = _joined(out, quantiles(voxels.where(v > 0), value, by, [0.5], "_q").select(*by, F.col("_q")[0].alias("median")), by)
    out = out.withColumn("valid_fraction", F.col("valid_voxels") / F.col("label_voxels")).withColumn("status", _state(F.col("label_voxels"), F.col("valid_fraction")))
    gone = F.col("status").startswith("missing")
    return out.withColumns({c: F.when(~gone, F.col(c)) for c in ("mean", *(["median"] if with_median else []))})


#: Worst-of: 2 missing, 1 attention, 0 pass.
def severity(status: Column) -> Column:
    return F.when(status.startswith("missing"), 2).when(status.startswith("attention"), 1).otherwise(0)


def state_of(severity_: Column) -> Column:
    return F.element_at(F.array(F.lit("pass"), F.lit("attention"), F.lit("missing")), severity_ + 1)


def label_sums(voxels: DataFrame, by: list[str], value: str = "pet", kind: str = "double") -> DataFrame:
    """by, label, measured, valid, total: measurements, valid ones (finite and above zero) and their sum. Sums of sums are sums: parts of a table can be summed apart.

    kind: the sum's type; a decimal makes it independent of the order of rows and parts.
    """
    v = F.col(value).cast("double")
    valid = F.when(finite(v) & (v > 0), v)
    return voxels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("measured"), F.count(valid).alias("valid"), F.sum(valid.cast(kind)).alias("total"))


def node_stats(voxels: DataFrame, hierarchy: DataFrame, by: list[str], value: str = "pet") -> DataFrame:
    """nodes_of() the label_sums() of voxels: the join and the second level see one row a label, not voxels."""
    return nodes_of(label_sums(voxels, by, value), hierarchy, by)


def nodes_of(labels: DataFrame, hierarchy: DataFrame, by: list[str]) -> DataFrame:
    """For each group and node: left, right and pooled means, asymmetry and worst status.

    labels: by, label, measured, valid, total as of label_sums(); hierarchy: label, side (L or R), node, composite. Pooled sums add
    both sides' measurements. The hierarchy is broadcast where its size allows, as Spark decides.
    """
    labels = labels.select(*by, "label", F.col("measured").alias("_n"), F.col("valid").alias("_k"), F.col("total").alias("_s")).join(hierarchy, "label")
    sides = {"left": F.col("side") == "L", "right": F.col("side") == "R", "pooled": F.lit(True)}
    sums = [F.sum(F.when(m, F.col(f"_{c}"))).alias(f"_{c}_{name}") for name, m in sides.items() for c in ("n", "k", "s")]
    # nodes without any voxel stay, as missing
    every = labels.select(*by).distinct().crossJoin(hierarchy.select("composite", "node").distinct())
    out = every.join(labels.groupBy(*by, "composite", "node").agg(*sums), [*by, "composite", "node"], "left")
    for name in sides:
        n, k = F.coalesce(f"_n_{name}", F.lit(0)), F.coalesce(f"_k_{name}", F.lit(0))
        state = _state(n, F.when(n > 0, k / n).otherwise(0.0))
        out = out.withColumn(f"_state_{name}", state).withColumn(name, F.when(~state.startswith("missing"), F.col(f"_s_{name}").cast("double") / k))
    worst = F.greatest(*[severity(F.col(f"_state_{name}")) for name in sides])
    total = F.col("left") + F.col("right")
    return out.select(*by, "composite", "node", "left", "right", "pooled", F.when(total != 0, 2 * (F.col("left") - F.col("right")) / total).alias("asymmetry"), state_of(worst).alias("status"))


def composites(nodes: DataFrame, by: list[str]) -> DataFrame:
    """For each composite: the unweighted mean of its nodes' pooled means, null if any is; and the worst status."""
    whole = F.count("pooled") == F.count(F.lit(1))
    return nodes.groupBy(*by, "composite").agg(F.count(F.lit(1)).alias("nodes"), F.when(whole, F.avg("pooled")).alias("value"), F.when(~whole, "missing").otherwise(state_of(F.max(severity(F.col("status"))))).alias("status"))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Sum of value x weight over sum of weight; null or non-positive entries fail."""
    ok = lambda c: required(F.coalesce(F.col(c) > 0, F.lit(False)), F.col(c).cast("double"), f"{c} must be positive")
    return df.groupBy(*by).agg((F.sum(ok(value) * ok(weight)) / F.sum(ok(weight))).alias("weighted_mean"), F.count(F.lit(1)).alias("n"))


def normalized_volume(volumes: DataFrame, whole: DataFrame, by: list[str]) -> DataFrame:
    """Sum of a subject's structure volumes over its intracranial volume."""
    ok = required(F.coalesce(F.col("volume") > 0, F.lit(False)), F.col("volume"), "volumes must be positive")
    total = volumes.groupBy(*by).agg(F.sum(ok).alias("volume"))
    return total.join(whole, by[0]).select(*by, (F.col("volume") / F.col("intracranial")).alias("normalized_volume"))


def label_volumes(voxels: DataFrame, by: list[str], voxel_volume: float) -> DataFrame:
    return voxels.groupBy(*by).agg(F.count(F.lit(1)).alias("voxels")).withColumn("volume", F.col("voxels") * F.lit(voxel_volume))


def weighted_reference(labels: DataFrame, by: list[str], node: str, beta: str, volume: str) -> DataFrame:
    """Volume-weighted mean of each node over the volume-weighted mean of its whole group; negative labels are flagged."""
    nodes = labels.groupBy(*by, node).agg(F.sum(F.col(beta) * F.col(volume)).alias("_bv"), F.sum(volume).alias("_v"), F.count_if(F.col(beta) < 0).alias("negative_labels"))
    whole = nodes.groupBy(*by).agg((F.sum("_bv") / F.sum("_v")).alias("reference"))
    return nodes.join(whole, by).select(*by, node, (F.col("_bv") / F.col("_v") / F.col("reference")).alias("ratio"), "negative_labels")


def face_labels(faces: DataFrame) -> DataFrame:
    """Of (face, v1, v2, v3), labels of three corners: the label of at least two, else that of the first."""
    return faces.withColumn("label", F.when(F.col("v2") == F.col("v3"), F.col("v2")).otherwise(F.col("v1")))


def parcel_faces(faces: DataFrame, values: DataFrame, parcels: int = 34) -> DataFrame:
    """hemisphere, label, value, faces: how many of a hemisphere's faces (hemisphere, v1, v2, v3) have each label that has a value (hemisphere, label, value).

    A label without faces fails, and so does a hemisphere with another number of labels than `parcels`. Faces whose label has no value are left out.
    """
    counts = face_labels(faces).groupBy("hemisphere", "label").agg(F.count(F.lit(1)).alias("_faces"))
    listed = values.groupBy("hemisphere").agg(F.count_distinct("label").alias("_labels"), F.count(F.lit(1)).alias("_rows"))
    met = values.join(listed, "hemisphere").join(counts, ["hemisphere", "label"], "left")
    whole = required((F.col("_labels") == parcels) & (F.col("_rows") == parcels), F.col("_faces"), f"a hemisphere needs {parcels} labels")
    return met.select("hemisphere", "label", "value", required(F.col("_faces").isNotNull(), whole, "a label has no faces").alias("faces"))
