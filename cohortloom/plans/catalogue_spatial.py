"""Named queries of patterns and spatial nulls: embeddings play compositions of 64 regions, their means by label the maps of an atlas of 32 parcels a hemisphere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import nulls, pattern, ranking, weights
from cohortloom.operators.linear import partial_spearman, ranks, residuals
from cohortloom.plans import spatial
from cohortloom.plans.catalogue import _centred, dense, query, rounded, table

HALF, DRAWS, BOOTS, SEED = 32, 9999, 2000, 20260912


def maps(spark, d) -> dict[int, np.ndarray]:
    """The mean vector of each label: 64 numbers for each of ten labels."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("m")).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.label, np.zeros(2 * HALF))[r.k] = r.m
    return out


def coordinates() -> np.ndarray:
    """A spiral on the right hemisphere's sphere, mirrored on the left."""
    i = np.arange(HALF)
    z, a = -0.95 + 1.9 * i / (HALF - 1), 5 * np.pi * i / (HALF - 1)
    right = np.column_stack([np.sqrt(1 - z * z) * np.cos(a), np.sqrt(1 - z * z) * np.sin(a), z])
    return np.vstack([right, right * [-1, 1, 1]])


def graph(coords: np.ndarray) -> np.ndarray:
    return spatial.graph_weights(coords[:HALF])


def design(m: dict[int, np.ndarray], coords: np.ndarray) -> np.ndarray:
    """Hemisphere, and ranks of the second coordinate and of a map."""
    return pattern.nuisance(np.column_stack([coords[:, 1], m[3]]), HALF)


MAPS = """WITH c AS (SELECT label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, pos, avg(v) AS v FROM c GROUP BY ALL),
g AS (SELECT i, -0.95 + 1.9 * i / 31 AS z, 5 * pi() * i / 31 AS a FROM range(32) t(i)), s AS (SELECT i, sqrt(1 - z * z) * cos(a) AS x, sqrt(1 - z * z) * sin(a) AS y, z FROM g),
k AS (SELECT a.i AS src, b.i AS dst FROM s a, s b WHERE a.i <> b.i QUALIFY row_number() OVER (PARTITION BY a.i ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.i) <= 5),
e AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k)"""


@query(MAPS + """, x AS (SELECT pos // 32 AS h, pos % 32 AS i, v FROM m WHERE label = 0), q AS (SELECT h, i, v - avg(v) OVER (PARTITION BY h) AS z FROM x),
r AS (SELECT a.h, 32 / count(*) * sum(a.z * b.z) / (SELECT sum(z * z) FROM q WHERE q.h = a.h) AS moran FROM e JOIN q a ON a.i = e.src JOIN q b ON b.h = a.h AND b.i = e.dst GROUP BY a.h)
SELECT CASE h WHEN 0 THEN 'right' ELSE 'left' END AS hemi, 9999 AS draws, round(moran, 6) AS moran, round(moran, 6) AS moran_low, round(moran, 6) AS moran_high, round((SELECT sum(v * v) FROM x), 6) AS norm2_low, round((SELECT sum(v * v) FROM x), 6) AS norm2_high FROM r""")
def q_msr_invariants(spark, d):
    """What every one of the spectral nulls shares with the map: each hemisphere's Moran's I and the norm; lowest and highest over all draws."""
    coords, m = coordinates(), maps(spark, d)
    plan = nulls.hemispheres(m[0], graph(coords))
    told = nulls.null_statistics(spark, plan, m[1][:, None], DRAWS, SEED)
    seen = nulls.observed_statistics(plan, m[1][:, None])["moran"]
    cells = [f("norm2").alias(f"norm2_{n}") for n, f in (("low", F.min), ("high", F.max))] + [f(F.col("moran")[k]).alias(f"{h}_{n}") for k, h in enumerate(plan.graphs) for n, f in (("low", F.min), ("high", F.max))]
    one = told.agg(F.count(F.lit(1)).cast("int").alias("draws"), *cells)
    rows = [F.struct(F.lit(h).alias("hemi"), F.lit(seen[k]).alias("moran"), F.col(f"{h}_low").alias("moran_low"), F.col(f"{h}_high").alias("moran_high")) for k, h in enumerate(plan.graphs)]
    return rounded(one.select("draws", "norm2_low", "norm2_high", F.explode(F.array(*rows)).alias("r")).select("r.*", "draws", "norm2_low", "norm2_high"), "moran", "moran_low", "moran_high", "norm2_low", "norm2_high")


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {n}"


@query(MAPS + """, p AS (SELECT pos, pos // 32 AS h, pos % 32 AS i, max(v) FILTER (label = 0) AS x, max(v) FILTER (label = 1) AS t1, max(v) FILTER (label = 2) AS t2, max(v) FILTER (label = 3) AS w FROM m GROUP BY pos),
o AS (SELECT pos, h, p.i, p.x, t1, t2, w, s.y FROM p JOIN s ON s.i = p.i), r AS (SELECT pos, h, i, """ + ", ".join(_RANK.format(c=c, n=n) for c, n in (("x", "x"), ("t1", "a"), ("t2", "b"), ("round(y, 12)", "u"), ("w", "w"))) + """ FROM o),
r1 AS (SELECT pos, h, i, """ + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY h) AS {c}" for c in "xabuw") + """ FROM r),
r2 AS (SELECT pos, h, i, """ + ", ".join(f"{c} - u * (SELECT sum({c} * u) / sum(u * u) FROM r1) AS {c}" for c in "xabw") + """ FROM r1),
r3 AS MATERIALIZED (SELECT pos, h, i, """ + ", ".join(f"{c} - w * (SELECT sum({c} * w) / sum(w * w) FROM r2) AS {c}" for c in "xab") + """ FROM r2),
mo AS (SELECT 64 / count(*) * sum(f.x * g.x) / (SELECT sum(x * x) FROM r3) AS moran FROM e JOIN r3 f ON f.i = e.src JOIN r3 g ON g.h = f.h AND g.i = e.dst)
SELECT target, round(rho, 6) AS partial_rho, 9999 AS draws, round(ss, 4) AS norm2_low, round(ss, 4) AS norm2_high, round(moran, 6) AS moran_low, round(moran, 6) AS moran_high, true AS orthogonal
FROM (SELECT unnest(['map1', 'map2']) AS target, unnest([sum(x * a) / sqrt(sum(x * x) * sum(a * a)), sum(x * b) / sqrt(sum(x * x) * sum(b * b))]) AS rho, sum(x * x) AS ss FROM r3), mo""")
def q_conditional_nulls(spark, d):
    """Partial rank correlations given hemisphere and two gradients, and what every conditional null shares with the map: norm, Moran's I, orthogonality to the design."""
    coords, m = coordinates(), maps(spark, d)
    z = design(m, np.round(coords, 12))
    held = residuals(ranks(np.column_stack([m[1], m[2]])), z)
    plan = nulls.conditional(m[0], z, np.kron(np.eye(2), graph(coords)))
    told = nulls.null_statistics(spark, plan, held, DRAWS, SEED)
    rho = nulls.observed_statistics(plan, held)["r"]
    one = told.agg(F.count(F.lit(1)).cast("int").alias("draws"), F.round(F.min("norm2"), 4).alias("norm2_low"), F.round(F.max("norm2"), 4).alias("norm2_high"), F.round(F.min(F.col("moran")[0]), 6).alias("moran_low"), F.round(F.max(F.col("moran")[0]), 6).alias("moran_high"), (F.max("nuisance") < 1e-8).alias("orthogonal"))
    targets = F.explode(F.create_map(*[F.lit(v) for k, v in enumerate(rho) for v in (f"map{k + 1}", round(v, 6))])).alias("target", "partial_rho")
    return one.select("*", targets)


@query(None)
def q_msr(spark, d):
    """The map against three others, by 9,999 spectral nulls: correlations, tails, Benjamini and Hochberg's q and the nulls' distribution."""
    coords, m = coordinates(), maps(spark, d)
    targets = np.column_stack([m[1], m[2], m[3]])
    plan = nulls.hemispheres(m[0], graph(coords))
    return spatial.family_of(nulls.null_statistics(spark, plan, targets, DRAWS, SEED), nulls.observed_statistics(plan, targets)["r"], ("map1", "map2", "map3"), method="bh")


@query(None)
def q_spin(spark, d):
    """Spun maps' Spearman correlations with a gradient: the tail of the unspun one, and how many of 9,999 spins are permutations within hemispheres."""
    coords, m = coordinates(), maps(spark, d)
    x, target = ranks(m[0]), ranks(coords[:, [1]])
    told = nulls.spin_statistics(spark, coords, x, target, DRAWS, 20260913, 4 * spark.sparkContext.defaultParallelism)
    seen = float(nulls.correlations(x[None, :], target)[0, 0])
    r = F.col("r")[0]
    return told.agg(F.lit(seen).alias("observed"), ranking.tail_p(r, F.lit(seen)).alias("p"), F.avg(r).alias("null_mean"), F.count(F.lit(1)).alias("draws"), F.count_if("valid").alias("valid"), F.count_if("identity").alias("identities"))


@query(None)
def q_dat_condition(spark, d):
    """Partial Spearman correlations given hemisphere and gradients, with what the design leaves of each map."""
    coords, m = coordinates(), maps(spark, d)
    z = design(m, np.round(coords, 12))
    others = np.column_stack([m[k] for k in (1, 2, 4)])
    kept = [pattern.retained(c, z) for c in others.T]
    return spark.createDataFrame([(k, float(v), o["retained"], o["vif"]) for k, (v, o) in enumerate(zip(partial_spearman(m[0], others, z), kept))], "target long, partial_rho double, retained double, vif double")


def rows_of(spark, d) -> DataFrame:
    """row_pos from 0, z: every vector's centred log ratios."""
    return dense(_centred(spark, d).withColumnRenamed("vec_id", "row_pos"))


@query(f"SELECT {BOOTS} AS draws, count(*) AS low, count(*) AS high, {BOOTS} * count(*) AS total FROM embeddings")
def q_multinomial_weights(spark, d):
    """Every bootstrap draw has as many rows, with repeats, as there are vectors."""
    n = table(spark, d, "embeddings").count()
    totals = weights.weights(spark, n, BOOTS, SEED).groupBy("draw").agg(F.sum("weight").alias("n"))
    return totals.agg(F.count(F.lit(1)).cast("int").alias("draws"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum("n").alias("total"))


@query(None)
def q_pc1_bootstrap(spark, d):
    """2,000 bootstrap draws of the first component, from moments weighted by each draw."""
    rows = rows_of(spark, d)
    n, total, products = pattern.moments(rows, "z")
    f = pattern.component_of_moments(n, total, products)
    return weights.component_draws(rows, f["loading"] * pattern.sign_by_largest(f["loading"]), f["centre"], int(n), BOOTS, 20260910)


@query(f"SELECT {BOOTS} AS draws, 0 AS degenerate, true AS unit, true AS ordered, true AS aligned, (SELECT count(*) FROM embeddings) AS n")
def q_stratified_bootstrap(spark, d):
    """2,000 draws within even and odd vectors: every draw has a component of length 1, ordered eigenvalues and the reference's direction."""
    rows = rows_of(spark, d).withColumn("scanner", F.col("row_pos") % 2)
    n, total, products = pattern.moments(rows, "z")
    f = pattern.component_of_moments(n, total, products)
    out = weights.stratified_component_draws(rows, "scanner", f["loading"] * pattern.sign_by_largest(f["loading"]), BOOTS, 20261025)
    length = F.aggregate("loading", F.lit(0.0), lambda s, v: s + v * v)
    return out.agg(F.count(F.lit(1)).cast("int").alias("draws"), F.count_if("degenerate").cast("int").alias("degenerate"), (F.max(F.abs(length - 1)) < 1e-11).alias("unit"), (F.min(F.col("eigen1") - F.col("eigen2")) >= 0).alias("ordered"), (F.min("cosine") >= 0).alias("aligned"), F.lit(int(n)).cast("long").alias("n"))


@query(None)
def q_three_targets(spark, d):
    """The vectors' pattern against a map taken as the original pattern and two as receptors: effects with 2,000 bootstrap draws and families of 9,999 nulls."""
    coords, m = coordinates(), maps(spark, d)
    regions = [f"r{k}" for k in range(2 * HALF)]
    atlas = spatial.Atlas(list(range(2 * HALF))[::-1], coords, np.column_stack([coords[:, 1], m[3]]), np.column_stack([m[1], m[2]]))
    out = spatial.three_targets(rows_of(spark, d), regions, ("r3", "r4"), m[0], atlas, BOOTS, DRAWS)
    families = out["primary_family"].withColumn("analysis", F.lit("primary")).unionByName(out["gradient_family"].withColumn("analysis", F.lit("gradient")))
    return out["effects"].join(families.select("analysis", "target", "p", "q"), ["analysis", "target"], "left")


@query(None)
def q_spatial_diagnostics(spark, d):
    """Norm, orthogonality, agreement of the halves and Moran's I on nine graphs, of the map and over 9,999 conditional nulls."""
    coords, m = coordinates(), maps(spark, d)
    z = design(m, np.round(coords, 12))
    targets = residuals(ranks(np.column_stack([m[1], m[2]])), z)
    plan = nulls.conditional(m[0], z, np.kron(np.eye(2), graph(coords)), spatial.diagnostic_graphs(coords))
    return spatial.diagnostics(nulls.null_statistics(spark, plan, targets, DRAWS, SEED), plan, targets)
