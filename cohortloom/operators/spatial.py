"""Spatial statistics as edge lists and long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.columns import correlation, finite, required
from cohortloom.operators.ranking import average_ranks
from cohortloom.sources.workspace import written


#: Halvings of a group's box: cells of the finest level are this power of two to a side.
LEVELS = 20


def nearest(points: DataFrame, k: int, by: list[str], pos: str = "pos", coords: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """by, src, dst, distance, rank: the k nearest others of each point within its group, ties by dst.

    Exact, by cells. Each group's box is halved LEVELS times. The finest cell of a place that has more than k points bounds
    its distance to the k-th other: it looks at the coarser level at which this distance reaches into at most two cells
    along each axis, and only pairs within the distance go on from where they met. Points with a coordinate that isn't finite
    are left out. Points of one place are one place with its k + 1 smallest dst, which are all that ties can ask for. Groups
    of any size and density are compared cell with cell; places and their bounds are written once.
    """
    axes = [f"_c{i}" for i in range(len(coords))]
    flat = points.select(*by, F.col(pos).alias("_pos"), *[F.col(c).cast("double").alias(a) for c, a in zip(coords, axes)])
    for a in axes:
        flat = flat.where(finite(F.col(a)))
    # the k + 1 smallest of each place: row numbers up to a limit are kept map-side
    first = Window.partitionBy(*by, *axes).orderBy("_pos")
    few = flat.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).groupBy(*by, *axes).agg(F.collect_list("_pos").alias("_few"))
    sizes = flat.groupBy(*by, *axes).agg(F.count(F.lit(1)).alias("_n"))
    box = sizes.groupBy(*by).agg(*[F.min(a).alias(f"_low{a}") for a in axes], F.greatest(*[F.max(a) - F.min(a) for a in axes], F.lit(0.0), F.lit(0.0)).alias("_side"))
    placed = _same(_same(few, sizes, [*by, *axes]), box, by)

    def cell(a: str, v: Column) -> Column:
        steps = F.floor((v - F.col(f"_low{a}")) / F.nullif(F.col("_side"), F.lit(0.0)) * (1 << LEVELS))
        return F.coalesce(F.greatest(F.least(steps, F.lit((1 << LEVELS) - 1)), F.lit(0)), F.lit(0)).cast("long")

    fine = [f"_f{a}" for a in axes]
    placed = written(placed.select("*", *[cell(a, F.col(a)).alias(f) for a, f in zip(axes, fine)]), "places")
    # the finest level at which a place's cell has more than k points; at level 0 it is the group
    cells = [f"_g{f}" for f in fine]
    up = lambda f: F.expr(f"shiftright({f}, {LEVELS} - _level)").alias(f"_g{f}")
    levels = placed.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    full = levels.select(*by, "_n", "_level", *map(up, fine)).groupBy(*by, "_level", *cells).agg(F.sum("_n").alias("_m")).where(F.col("_m") > k)
    keyed = levels.where("_level > 0").select(*by, *axes, "_level", *map(up, fine))
    own = _same(keyed, full, [*by, "_level", *cells]).groupBy(*by, *axes).agg(F.max("_level").alias("_level"))
    homes = written(_same(placed, own, [*by, *axes], "left").withColumn("_level", F.coalesce("_level", F.lit(0))), "homes")
    # within it, the distance at which so many points are reached: a bound, or none if the whole group hasn't as many
    gap = lambda: reduce(lambda s, g: s + g, [(F.col(f"_a{a}") - F.col(a)) * (F.col(f"_a{a}") - F.col(a)) for a in axes])
    asked = [F.col(a).alias(f"_a{a}") for a in axes]
    there = _asked(placed, homes.where(F.col("_n") <= k), by).select(*by, "_level", *map(up, fine), *axes, "_n")
    inside = _same(homes.where(F.col("_n") <= k).select(*by, *asked, "_level", *map(up, fine)), there, [*by, "_level", *cells]).select(*by, *[f"_a{a}" for a in axes], "_n", F.sqrt(gap()).alias("_d"))
    of_place = Window.partitionBy(*by, *[f"_a{a}" for a in axes]).orderBy("_d")
    inside = inside.withColumn("_r", F.row_number().over(of_place)).where(F.col("_r") <= k + 1)
    inside = inside.withColumn("_met", F.sum("_n").over(of_place.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = inside.groupBy(*by, *[F.col(f"_a{a}").alias(a) for a in axes]).agg(F.min(F.when(F.col("_met") > k, F.col("_d"))).alias("_reach"))
    asks = _same(homes.drop("_level"), bounds, [*by, *axes], "left")
    asks = asks.withColumn("_reach", F.when(F.col("_n") > k, 0.0).otherwise(F.coalesce("_reach", F.lit(float("inf")))))
    # a little farther, for what rounding may hide
    far = lambda a: F.col("_reach") * (1 + 1e-12) + (F.abs(F.col(a)) + F.col("_reach")) * 1e-15 + 1e-150
    asks = asks.select("*", *[cell(a, F.col(a) - far(a)).alias(f"_l{a}") for a in axes], *[cell(a, F.col(a) + far(a)).alias(f"_h{a}") for a in axes])
    widest = F.greatest(*[F.col(f"_h{a}") - F.col(f"_l{a}") for a in axes], F.lit(1), F.lit(1))
    asks = written(asks.withColumn("_level", F.lit(LEVELS) - F.ceil(F.log2(widest)).cast("int")).drop("_n", "_few", *fine), "asks")
    there = _asked(placed, asks, by).select(*by, "_level", *map(up, fine), *axes, "_few")
    wide = asks.select(*by, *asked, "_reach", "_level", *[F.expr(f"sequence(shiftright(_l{a}, {LEVELS} - _level), shiftright(_h{a}, {LEVELS} - _level))").alias(f"_s{a}") for a in axes])
    for a, c in zip(axes, cells):
        wide = wide.withColumn(c, F.explode(f"_s{a}")).drop(f"_s{a}")
    pairs = _same(wide, there, [*by, "_level", *cells]).withColumn("distance", F.sqrt(gap())).where(F.col("distance") <= F.col("_reach"))
    near = pairs.select(*by, *[f"_a{a}" for a in axes], F.explode("_few").alias("dst"), "distance")
    # a point's own place is among them: one more than k, and then the point itself is left out
    of_place = Window.partitionBy(*by, *[f"_a{a}" for a in axes]).orderBy("distance", "dst")
    near = near.withColumn("_r", F.row_number().over(of_place)).where(F.col("_r") <= k + 1).drop("_r")
    near = near.select(*by, *[F.col(f"_a{a}").alias(a) for a in axes], "dst", "distance")
    each = _same(flat.withColumnRenamed("_pos", "src"), near, [*by, *axes]).where("src <> dst")
    of_point = Window.partitionBy(*by, "src").orderBy("distance", "dst")
    return each.withColumn("rank", F.row_number().over(of_point)).where(F.col("rank") <= k).select(*by, "src", "dst", "distance", "rank")


def _asked(placed: DataFrame, asks: DataFrame, by: list[str]) -> DataFrame:
    """placed at each level at which its group is asked for anything: one row each."""
    return _same(placed, asks.groupBy(*by).agg(F.collect_set("_level").alias("_levels")), by).withColumn("_level", F.explode("_levels"))


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with b's other columns where the keys are the same, nulls included."""
    if not keys:
        return a.crossJoin(b)
    other = b.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *[c for c in b.columns if c not in keys])
    on = F.col(keys[0]).eqNullSafe(F.col(f"_k_{keys[0]}"))
    for c in keys[1:]:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return a.join(other, on, how).drop(*[f"_k_{c}" for c in keys])


def distinct_points(points: DataFrame, by: list[str], coords: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """points, unless two of a group are in the same place: then the query fails."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, *coords))
    return points.withColumn(coords[0], required(n == 1, F.col(coords[0]), "two points are in the same place"))


def symmetric(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, src, dst, w = 1 of edges in either direction."""
    both = edges.select(*by, "src", "dst").union(edges.select(*by, F.col("dst"), F.col("src")))
    return both.distinct().withColumn("w", F.lit(1.0))


def averaged(edges: DataFrame, hemispheres: int = 2) -> DataFrame:
    """src, dst, w: the mean over hemispheres of weights; an edge that one lacks counts 0 there."""
    return edges.groupBy("src", "dst").agg((F.sum("w") / hemispheres).alias("w"))


def moran(values: DataFrame, edges: DataFrame, by: list[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """by, moran: n / sum(w) x sum(w zi zj) / sum(z^2) of each map over one edge list."""
    means = values.groupBy(*by).agg(F.avg(value).alias("_mean"))
    z = values.join(means, by).select(*by, F.col(pos).alias("pos"), (F.col(value) - F.col("_mean")).alias("z"))
    spread = z.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("z") * F.col("z")).alias("_ss"))
    i = z.select(*by, F.col("pos").alias("src"), F.col("z").alias("zi"))
    j = z.select(*by, F.col("pos").alias("dst"), F.col("z").alias("zj"))
    cross = i.join(edges.select("src", "dst", "w"), "src").join(j, [*by, "dst"]).groupBy(*by).agg(F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("_c"))
    return cross.join(spread, by).select(*by, (F.col("_n") / F.col("_w") * F.col("_c") / F.col("_ss")).alias("moran"))


def map_correlations(maps: DataFrame, targets: DataFrame, strict: bool = False) -> DataFrame:
    """draw, target, r: Pearson correlation of every map (draw, pos, value) with every target (target, pos, t), within -1 and 1; null without spread.

    strict: a map or target without spread, or with a value that isn't finite, fails.
    """
    r = correlation(F.col("value"), F.col("t"))
    whole = F.count_if(~finite(F.col("value")) | ~finite(F.col("t"))) == 0
    return maps.join(targets, "pos").groupBy("draw", "target").agg((required(whole & finite(r), r, "a map or target has no spread or isn't finite") if strict else r).alias("r"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, rho: Pearson correlation of average ranks."""
    ranked = average_ranks(average_ranks(df.select(*by, x, y), x, by, "_x"), y, by, "_y")
    return ranked.groupBy(*by).agg(correlation(F.col("_x"), F.col("_y")).alias("rho"))


def partial_one(df: DataFrame, x: str, y: str, covariate: str, by: list[str]) -> DataFrame:
    """by, r: correlation of x and y given one covariate, from three correlations of one pass."""
    s = df.groupBy(*by).agg(*[correlation(F.col(u), F.col(v)).alias(n) for n, u, v in (("a", x, y), ("b", x, covariate), ("c", y, covariate))])
    return s.select(*by, ((F.col("a") - F.col("b") * F.col("c")) / F.nullif(F.sqrt((1 - F.col("b") * F.col("b")) * (1 - F.col("c") * F.col("c"))), F.lit(0.0))).alias("r"))


def residual_one(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """df with residual: y less its least-squares line in x within each group."""
    line = df.groupBy(*by).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return df.join(line, by).withColumn("residual", F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")


def gather_spins(values: DataFrame, spins: DataFrame, value: str = "value") -> DataFrame:
    """draw, pos, value: each draw's map, taken from the positions that its permutation array names."""
    long = spins.select("draw", F.posexplode("perm").alias("pos", "_from"))
    return long.join(F.broadcast(values.select(F.col("pos").alias("_from"), F.col(value).alias("value"))), "_from").select("draw", "pos", "value")


def permutation_counts(spins: DataFrame, n: int) -> DataFrame:
    """One row: draws, distinct permutations, identities, and arrays that aren't permutations."""
    whole = F.sequence(F.lit(0), F.lit(n - 1))
    return spins.agg(F.count(F.lit(1)).alias("draws"), F.count_distinct("perm").alias("distinct_permutations"), F.count_if(F.col("perm").cast("array<int>") == whole).alias("identities"), F.count_if(F.sort_array(F.col("perm").cast("array<int>")) != whole).alias("not_permutations"))


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
