"""Spatial analyses of one cohort's pattern: families of tests against nulls, spins, bootstraps and atlas comparisons.

Matrices of one cohort (people x regions, parcels x targets) are kernel
arguments; what grows, draws x targets, stays in tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import metrics, pattern, ranking, spatial, weights
from cohortloom.operators import nulls as nulls_
from cohortloom.operators.contracts import ContractError
from cohortloom.operators.linear import ranks, residuals


def effects(observed: np.ndarray, targets: np.ndarray, names: list[str], spark: SparkSession) -> DataFrame:
    """target, observed: correlation of a map with each column."""
    r = [float(np.corrcoef(observed, t)[0, 1]) for t in targets.T]
    return spark.createDataFrame(list(zip(names, r)), "target string, observed double")


def long_maps(spark: SparkSession, maps: np.ndarray) -> DataFrame:
    """draw, pos, value of draws x parcels."""
    rows = spark.createDataFrame([(k, m.tolist()) for k, m in enumerate(maps)], "draw long, m array<double>")
    return rows.select("draw", F.posexplode("m").alias("pos", "value"))


def long_targets(spark: SparkSession, targets: np.ndarray, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, k, float(v)) for n, t in zip(names, targets.T) for k, v in enumerate(t)], "target string, pos int, t double")


def spatial_family(nulls: DataFrame, observed: DataFrame, count: int, method: str = "bh") -> DataFrame:
    """target, observed, p, adjusted p (q of Benjamini-Hochberg, or Holm) and the null's distribution; exactly count targets, else an error.

    nulls: draw, target, r.
    """
    if observed.count() != count:
        raise ContractError(f"the family must have {count} targets")
    joined = nulls.join(F.broadcast(observed), "target")
    p = joined.groupBy("target", "observed").agg(ranking.tail_p(F.col("r"), F.col("observed")).alias("p"))
    p = p.join(metrics.distribution(nulls, "r", ["target"], bounded=True), "target").withColumn("_f", F.lit(1))
    adjust = ranking.benjamini_hochberg if method == "bh" else ranking.holm
    return adjust(p, "p", ["_f"], ["target"], "q").drop("_f")


def spin_statistics(spark: SparkSession, x: np.ndarray, targets: np.ndarray, names: list[str], spins: DataFrame) -> DataFrame:
    """target, rho, p, p_centred (of deviations from the null's mean), pearson, null_mean and null quantiles of ranked maps under spins (draw, perm)."""
    values = spark.createDataFrame([(k, float(v)) for k, v in enumerate(ranks(x))], "pos int, value double")
    null = spatial.map_correlations(spatial.gather_spins(values, spins), F.broadcast(long_targets(spark, ranks(targets), names)))
    seen = effects(ranks(x), ranks(targets), names, spark).withColumnRenamed("observed", "rho").join(effects(x, targets, names, spark).withColumnRenamed("observed", "pearson"), "target")
    mean = null.groupBy("target").agg(F.avg("r").alias("null_mean"))
    joined = null.join(F.broadcast(seen), "target").join(F.broadcast(mean), "target")
    out = joined.groupBy("target", "rho", "pearson", "null_mean").agg(ranking.tail_p(F.col("r"), F.col("rho")).alias("p"), ranking.centred_tail_p(F.col("r"), F.col("null_mean"), F.col("rho")).alias("p_centred"), F.percentile("r", F.array(*[F.lit(q) for q in (0.0, 0.025, 0.5, 0.975, 1.0)])).alias("null_quantiles"))
    return out


def bootstrap_effects(loadings: DataFrame, targets: DataFrame, crosswalk: list[int]) -> DataFrame:
    """draw, target, r: each bootstrap loading's correlation with every target, through a crosswalk of region positions; degenerate draws give null."""
    picked = loadings.select("draw", F.posexplode(F.transform(F.array(*[F.lit(i) for i in crosswalk]), lambda i: F.get("loading", i))).alias("pos", "value"))
    return spatial.map_correlations(picked, F.broadcast(targets))


def paired_strength(draws: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, lo, hi, positive: distribution over draws of |r of a| - |r of b|."""
    table = draws.sparkSession.createDataFrame(pairs, "a string, b string")
    one, two = draws.select("draw", F.col("target").alias("a"), F.col("r").alias("ra")), draws.select("draw", F.col("target").alias("b"), F.col("r").alias("rb"))
    both = F.broadcast(table).join(one, "a").join(two, ["draw", "b"]).withColumn("d", F.abs("ra") - F.abs("rb"))
    return metrics.distribution(both, "d", ["a", "b"], bounded=True)


def direction_share(draws: DataFrame, observed: DataFrame) -> DataFrame:
    """target, same_direction: the share of draws whose effect has the observed sign."""
    return draws.join(F.broadcast(observed), "target").groupBy("target").agg(F.avg((F.signum("r") == F.signum("observed")).cast("double")).alias("same_direction"))


def graph_weights(coords: np.ndarray, k: int = 5, from_first: bool = False) -> np.ndarray:
    """Symmetric k-nearest weights of one hemisphere's points. from_first: neighbours are the sorted places 1 to k, the point itself
    not set aside (so that a twin at distance 0 may take its place); else twins are an error."""
    d = np.linalg.norm(coords[:, None] - coords[None], axis=2)
    if not from_first:
        np.fill_diagonal(d, np.inf)
        if d.min() <= 0:
            raise ValueError("two points are in the same place")
    near = np.argsort(d, axis=1, kind="stable")[:, int(from_first) : int(from_first) + k]
    w = np.zeros_like(d)
    w[np.arange(len(d))[:, None], near] = 1
    return np.maximum(w, w.T)


def external_cohort(spark: SparkSession, raw: np.ndarray, regions: list[str], anchors: tuple[str, str], crosswalk: list[int], targets: np.ndarray, names: list[str], coords: np.ndarray, gradients: np.ndarray, boots: int = 2000, nulls: int = 9999, seeds: tuple[int, int, int, int] = (1, 2, 3, 4)) -> dict[str, DataFrame]:
    """The whole analysis: pattern, bootstrap, spectral nulls, conditional nulls and spins, each with its family.

    raw: people x regions, positive; targets, gradients and coords: of the cortical parcels, right half first.
    """
    z = np.log(raw)
    z = z - z.mean(axis=1, keepdims=True)
    f = pattern.first_component(z)
    sign, rule = pattern.sign_by_anchor(f["loading"], regions, anchors)
    loading, n = f["loading"] * sign, len(coords) // 2
    x = loading[crosswalk]
    w = (graph_weights(coords[:n]) + graph_weights(coords[n:])) / 2
    t = long_targets(spark, targets, names)
    boot = pattern.bootstrap_components(spark, z, loading, np.random.Generator(np.random.PCG64(seeds[0])).integers(0, len(z), (boots, len(z))))
    free = pattern.hemisphere_nulls(x, w, pattern.random_signs(nulls, n - 1, seeds[1]))
    design = pattern.nuisance(gradients, n)
    both = np.kron(np.eye(2), w)
    e, held = pattern.conditional_nulls(ranks(x), design, both, pattern.random_signs(nulls, 2 * n - design.shape[1], seeds[2]))
    rest = residuals(ranks(targets), design)
    draws = bootstrap_effects(boot, t, crosswalk)
    seen = effects(x, targets, names, spark)
    return {
        "pattern": spark.createDataFrame([(r, float(v), f["eigen1"], f["explained"], rule) for r, v in zip(regions, loading)], "region string, loading double, eigen1 double, explained double, sign_rule string"),
        "bootstrap": boot,
        "intervals": metrics.distribution(draws, "r", ["target"], bounded=True).join(direction_share(draws, seen), "target"),
        "spectral": spatial_family(spatial.map_correlations(long_maps(spark, free), F.broadcast(t)), seen, len(names)),
        "conditional": spatial_family(spatial.map_correlations(long_maps(spark, held), F.broadcast(long_targets(spark, rest, names))), effects(e, rest, names, spark), len(names)),
        "spins": spin_statistics(spark, x, targets, names, pattern.spins(spark, coords, nulls, seeds[3])),
    }


#: Fixed values of the three-target analysis: its targets, those of them that gradients are taken out of, and the signs expected of the three.
TARGETS, GRADIENT_TARGETS, DIRECTIONS = ("original_PC1", "receptor_a", "receptor_b"), ("receptor_a", "receptor_b"), (1, -1, 1)
SEEDS = {"bootstrap": 2026102401, "msr": 2026102402, "conditional": 2026102404}


def family_of(nulls: DataFrame, seen: list[float], names: tuple[str, ...], column: str = "r", method: str = "holm") -> DataFrame:
    """target, observed, p, q, the null's distribution: of nulls (draw, array of a correlation for each name) the two-sided tail, adjusted over the names."""
    spark = nulls.sparkSession
    observed = spark.createDataFrame(list(zip(names, seen)), "target string, observed double")
    long = nulls.select("draw", F.posexplode(column).alias("k", "r")).select("draw", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1).alias("target"), "r")
    return spatial_family(long, observed, len(names), method)


def diagnostics(nulls: DataFrame, plan: nulls_.Plan, targets: np.ndarray) -> DataFrame:
    """quantity, original, min, q025, median, q975, max: norm, largest product with the design, cosine of the halves and each graph's
    Moran's I, of the observed map and over all nulls."""
    seen = nulls_.observed_statistics(plan, targets)
    names = ["norm", "nuisance", "cosine", *plan.graphs]
    original = [seen["norm2"] ** 0.5, seen["nuisance"], seen["cosine"], *seen["moran"]]
    cells = F.concat(F.array(F.sqrt("norm2"), F.col("nuisance"), F.col("cosine")), F.col("moran"))
    long = nulls.select(F.posexplode(cells).alias("k", "v")).select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1).alias("quantity"), "v")
    told = metrics.distribution(long, "v", ["quantity"], bounded=True).select("quantity", "min", "q025", "median", "q975", "max")
    return told.join(nulls.sparkSession.createDataFrame(list(zip(names, original)), "quantity string, original double"), "quantity")


def diagnostic_graphs(coords: np.ndarray, ks: tuple[int, ...] = (3, 5, 8)) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each k the mean graph of both halves: on the whole map, the right half and the left half."""
    n, out = len(coords) // 2, {}
    for k in ks:
        w = (graph_weights(coords[:n], k) + graph_weights(coords[n:], k)) / 2
        out |= {f"k{k}_global": (np.arange(2 * n), np.kron(np.eye(2), w)), f"k{k}_R": (np.arange(n), w), f"k{k}_L": (np.arange(n, 2 * n), w)}
    return out


def fit_branch(rows: DataFrame, branch: str, regions: list[str], anchors: tuple[str, str]) -> dict:
    """n, centre, loading, eigenvalues and the rule of the sign of the first component of rows (z: centred log ratios of all regions).

    original: the largest entry is positive; external: the anchors' mean is.
    """
    if branch not in ("original", "external") or len(set(regions)) != len(regions):
        raise ContractError("the branch is original or external, and regions are unique")
    moments = pattern.moments(rows, "z")
    if moments[0] < 3 or len(moments[1]) != len(regions):
        raise ContractError("at least three people with a value of each region are needed")
    f = pattern.component_of_moments(*moments)
    sign, rule = (pattern.sign_by_largest(f["loading"]), "largest") if branch == "original" else pattern.sign_by_anchor(f["loading"], regions, anchors)
    return f | {"n": int(moments[0]), "loading": f["loading"] * sign, "sign_rule": rule}


@dataclass(frozen=True)
class Atlas:
    """Parcels of an atlas, right half first: place in the regions' order, coordinates, two gradients, receptor maps (columns)."""

    crosswalk: list[int]
    coords: np.ndarray
    gradients: np.ndarray
    receptors: np.ndarray

    def __post_init__(self) -> None:
        n = len(self.crosswalk)
        if n % 2 or len(set(self.crosswalk)) != n or not len(self.coords) == len(self.gradients) == len(self.receptors) == n:
            raise ContractError("an atlas has two halves of equal size, unique regions and a row of each table for each parcel")


def three_targets(rows: DataFrame, regions: list[str], anchors: tuple[str, str], original: np.ndarray, atlas: Atlas, boots: int = 2000, nulls: int = 9999, seeds: dict = SEEDS, inferential: bool = True) -> dict[str, DataFrame]:
    """The pattern of an external cohort against an original pattern and two receptor maps.

    rows: row_pos (0 to n - 1) and z, centred log ratios of all regions. Tables: pattern; effects (Pearson with
    TARGETS, partial Spearman given hemisphere and gradients with GRADIENT_TARGETS, cosine with the original
    pattern) with bootstrap intervals and the share of draws in the expected direction; if inferential, primary
    and gradient families with Holm's correction against spectral and conditional spectral nulls, and diagnostics
    of both.
    """
    spark = rows.sparkSession
    f = fit_branch(rows, "external", regions, anchors)
    loading, ix, n = f["loading"], np.array(atlas.crosswalk), len(atlas.crosswalk) // 2
    targets = np.column_stack([original[ix], atlas.receptors])
    design = pattern.nuisance(atlas.gradients, n)
    held = residuals(ranks(atlas.receptors), design)
    x = loading[ix]
    w = (graph_weights(atlas.coords[:n]) + graph_weights(atlas.coords[n:])) / 2
    length = float(np.linalg.norm(original))

    def judged(loadings: np.ndarray) -> np.ndarray:
        """Rows of three correlations, two partial ones and a cosine."""
        maps = loadings[:, ix]
        rest = np.stack([residuals(ranks(m), design) for m in maps])
        return np.concatenate((nulls_.correlations(maps, targets), nulls_.correlations(rest, held), loadings @ original[:, None] / length), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values = judged(np.array(b.column(1).to_pylist(), float))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.tolist(), pa.list_(pa.float64()))], ["draw", "v"])

    kinds = [*(("primary", t) for t in TARGETS), *(("gradient", t) for t in GRADIENT_TARGETS), ("cosine", "original_pattern")]
    seen = judged(loading[None, :])[0]
    direction = dict(zip(TARGETS, DIRECTIONS))
    known = spark.createDataFrame([(k, a, t, float(v), direction.get(t) if a == "primary" else None) for k, ((a, t), v) in enumerate(zip(kinds, seen))], "k int, analysis string, target string, observed double, direction int")
    boot = weights.component_draws(rows, loading, f["centre"], f["n"], boots, seeds["bootstrap"])
    long = boot.where("not degenerate").select("draw", "loading").mapInArrow(run, "draw long, v array<double>").select("draw", F.posexplode("v").alias("k", "r"))
    spread = metrics.distribution(long, "r", ["k"], bounded=True)
    shares = long.join(F.broadcast(known), "k").groupBy("k").agg(F.avg(((F.col("r") * F.col("direction")) > 0).cast("double")).alias("expected_direction"))
    out = {
        "pattern": spark.createDataFrame([(r, float(v), f["eigen1"], f["explained"], f["sign_rule"]) for r, v in zip(regions, loading)], "region string, loading double, eigen1 double, explained double, sign_rule string"),
        "effects": known.join(spread, "k", "left").join(shares, "k", "left").select("analysis", "target", "observed", F.coalesce("n_finite", F.lit(0)).alias("n_finite"), "q025", "median", "q975", "expected_direction"),
    }
    if not inferential:
        return out
    graphs = diagnostic_graphs(atlas.coords)
    free = nulls_.hemispheres(x, w, graphs)
    tied = nulls_.conditional(x, design, np.kron(np.eye(2), w), graphs)
    primary = nulls_.null_statistics(spark, free, targets, nulls, seeds["msr"])
    gradient = nulls_.null_statistics(spark, tied, held, nulls, seeds["conditional"])
    return out | {
        "primary_family": family_of(primary, seen[:3].tolist(), TARGETS),
        "gradient_family": family_of(gradient, seen[3:5].tolist(), GRADIENT_TARGETS),
        "primary_diagnostics": diagnostics(primary, free, targets),
        "gradient_diagnostics": diagnostics(gradient, tied, held),
    }
