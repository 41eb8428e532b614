"""Performance statistics of outcomes and probabilities, and descriptive summaries.

All group by `by` (models, repeats, draws); none collects rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import wilson
from cohortloom.operators.quantiles import quantiles
from cohortloom.operators.ranking import rank_table, running_sums

#: Five bins in two roundings: halves of a fifth of one, and decimal fractions.
EDGES_FIFTHS = (1 / 5, 2 * (1 / 5), 3 * (1 / 5), 4 * (1 / 5))
EDGES_DECIMAL = (0.2, 0.4, 0.6, 0.8)


def auc(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """by, auc, n_pos, n_neg: from average ranks of distinct probabilities; ties count half, one class alone gives null."""
    ranks = rank_table(df, p, by)
    pos = df.groupBy(*by, p).agg(F.sum((F.col(y) == 1).cast("long")).alias("_pos"))
    cond = [*by, p]
    sums = ranks.join(pos, cond).groupBy(*by).agg(F.sum(F.col("rank") * F.col("_pos")).alias("_s"), F.sum("_pos").alias("n_pos"), F.sum(F.col("n") - F.col("_pos")).alias("n_neg"))
    a, b = F.col("n_pos"), F.col("n_neg")
    return sums.select(*by, F.when((a > 0) & (b > 0), (F.col("_s") - a * (a + 1) / F.lit(2.0)) / (a * b)).alias("auc"), "n_pos", "n_neg")


def pair_auc(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """by, above, equal, pairs, auc: how many pairs of a positive and a negative row are in order or tied, counted exactly.

    Pairs aren't made: below each distinct probability's positives are as many negatives as a running sum says.
    """
    counts = df.groupBy(*by, p).agg(F.sum((F.col(y) == 1).cast("long")).alias("_pos"), F.sum((F.col(y) == 0).cast("long")).alias("_neg"))
    sums = running_sums(counts, by, p, {"_below": "_neg"})
    n = F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0))
    above, equal = F.sum(F.col("_pos") * F.col("_below")), F.sum(F.col("_pos") * F.col("_neg"))
    return sums.groupBy(*by).agg(above.alias("above"), equal.alias("equal"), n.alias("pairs")).withColumn("auc", (F.col("above") + F.col("equal") / F.lit(2.0)) / F.col("pairs"))


def held_out_prevalence(df: DataFrame, y: str, group: str) -> DataFrame:
    """group, n_test, n_train, test_rate, prevalence_brier: each group's mean squared distance from the rate of all others.

    A training sum is the whole less the group's.
    """
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_test"), F.sum(y).alias("_k"))
    whole = groups.agg(F.sum("n_test").alias("_n"), F.sum("_k").alias("_all"))
    out = groups.crossJoin(whole).withColumn("n_train", F.col("_n") - F.col("n_test"))
    out = out.withColumns({"_m": (F.col("_all") - F.col("_k")) / F.nullif(F.col("n_train"), F.lit(0)), "test_rate": F.col("_k") / F.col("n_test")})
    m, rate = F.col("_m"), F.col("test_rate")
    return out.select(group, "n_test", "n_train", "test_rate", (rate * (1 - m) * (1 - m) + (1 - rate) * m * m).alias("prevalence_brier"))


def brier(y: Column, p: Column) -> Column:
    """Aggregate: mean squared error."""
    return F.avg((p - y) * (p - y))


def measures(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """by, n, auc, brier, status: one class alone keeps its Brier score and says so."""
    rest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), brier(F.col(y), F.col(p)).alias("brier"), F.count_distinct(y).alias("_classes"))
    out = rest.join(auc(df, y, p, by), by)
    return out.select(*by, "n", "auc", "brier", F.when(F.col("_classes") < 2, "NOT_ESTIMABLE_SINGLE_CLASS").otherwise("ESTIMABLE").alias("status"))


def mean_predictions(predictions: DataFrame) -> DataFrame:
    """model, row_pos, p: the mean over repeats of (model, repeat, row_pos, p)."""
    return predictions.groupBy("model", "row_pos").agg(F.avg("p").alias("p"))


def decision_curve(df: DataFrame, y: str, p: str, thresholds: list[float], by: list[str]) -> DataFrame:
    """by, threshold, model, treat_all, treat_none: net benefit at each of a short list of thresholds between 0 and 1."""
    if not all(0 < t < 1 for t in thresholds):
        raise ValueError("thresholds must lie between 0 and 1")
    odds = F.col("threshold") / (1 - F.col("threshold"))
    crossed = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return crossed.groupBy(*by, "threshold").agg(F.avg(((F.col(p) >= F.col("threshold")) & (F.col(y) == 1)).cast("double")).alias("_g"), F.avg(((F.col(p) >= F.col("threshold")) & (F.col(y) == 0)).cast("double")).alias("_h"), F.avg(F.col(y).cast("double")).alias("_m")).select(*by, "threshold", (F.col("_g") - F.col("_h") * odds).alias("model"), (F.col("_m") - (1 - F.col("_m")) * odds).alias("treat_all"), F.lit(0.0).alias("treat_none"))


def calibration_bins(df: DataFrame, y: str, p: str, by: list[str], edges: tuple[float, ...] = EDGES_FIFTHS) -> DataFrame:
    """Five fixed bins, closed below, the last closed above: bin, n, responders, mean_p, observed, low, high; empty bins stay, as nulls."""
    place = sum(((F.col(p) >= e).cast("int") for e in edges), F.lit(1))
    sums = df.groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("responders"), F.avg(p).alias("mean_p"))
    every = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(len(edges) + 1))))
    out = every.join(sums, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("responders", F.coalesce("responders", F.lit(0)))
    low, high = wilson(F.col("responders"), F.col("n"))
    return out.select(*by, "bin", "n", "responders", "mean_p", F.when(F.col("n") > 0, F.col("responders") / F.col("n")).alias("observed"), low.alias("low"), high.alias("high"))


def percentile_interval(df: DataFrame, x: str, by: list[str], bounded: bool = False) -> DataFrame:
    """by, lo, hi: exact 2.5 and 97.5 percentiles, linearly interpolated. bounded: groups are of few values, such as draws, and one task may have one."""
    probs = [0.025, 0.975]
    found = df.groupBy(*by).agg(F.percentile(x, F.array(*[F.lit(p) for p in probs])).alias("_q")) if bounded else quantiles(df, x, by, probs, "_q")
    return found.select(*by, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def distribution(df: DataFrame, x: str, by: list[str], bounded: bool = False) -> DataFrame:
    """by, n_finite, n_other, min, q025, median, q975, max, mcse (standard error of the mean), positive (share), negative; bounded as in percentile_interval()."""
    v = F.col(x).cast("double")
    ok = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
    probs = [0.025, 0.5, 0.975]
    cells = [F.count(ok).alias("n_finite"), (F.count(F.lit(1)) - F.count(ok)).alias("n_other"), F.min(ok).alias("min"), F.max(ok).alias("max"), (F.stddev_samp(ok) / F.sqrt(F.count(ok))).alias("mcse"), F.avg((ok > 0).cast("double")).alias("positive"), F.avg((ok < 0).cast("double")).alias("negative")]
    if bounded:
        rows = df.groupBy(*by).agg(*cells, F.percentile(ok, F.array(*[F.lit(p) for p in probs])).alias("_q"))
    else:
        rows = _joined(df.groupBy(*by).agg(*cells), quantiles(df, x, by, probs, "_q").drop("n"), by)
    return rows.select(*by, "n_finite", "n_other", "min", *[F.col("_q")[k].alias(n) for k, n in enumerate(("q025", "median", "q975"))], "max", "mcse", "positive", "negative")


def _joined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Two tables with a row a group side by side; null keys meet null keys."""
    if not by:
        return a.crossJoin(b)
    other = b.select(*[F.col(c).alias(f"_k_{c}") for c in by], *[c for c in b.columns if c not in by])
    on = F.col(by[0]).eqNullSafe(F.col(f"_k_{by[0]}"))
    for c in by[1:]:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return a.join(other, on, "left").drop(*[f"_k_{c}" for c in by])


_STATS = ("n", "mean", "sd", "median", "q1", "q3", "min", "max")


def descriptives(df: DataFrame, y: str, continuous: list[str], categorical: list[str]) -> DataFrame:
    """group_name (all, responder, nonresponder), field, level, statistic, value: one pass of grouping sets for
    numbers, one for categories; levels that a group lacks count 0."""
    name = lambda flag: F.when(flag == 1, "all").when(F.col(y) == 1, "responder").otherwise("nonresponder")
    long = df.select(y, F.explode(F.create_map(*[x for c in continuous for x in (F.lit(c), F.col(c).cast("double"))]))).toDF(y, "field", "v")
    sets = long.groupingSets([["field"], ["field", y]], "field", y)
    numbers = sets.agg(F.grouping(y).alias("_g"), F.count("v").cast("double").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"))
    # every value in its own group and in that of all, as the grouping sets have them
    twice = long.withColumn("_g", F.explode(F.array(F.lit(0), F.lit(1)))).select("field", F.when(F.col("_g") == 0, F.col(y)).alias(y), F.col("_g").cast("byte").alias("_g"), "v")
    numbers = _joined(numbers, quantiles(twice, "v", ["field", y, "_g"], [0.5, 0.25, 0.75], "_q").drop("n"), ["field", y, "_g"])
    numbers = numbers.select(name(F.col("_g")).alias("group_name"), "field", F.lit(None).cast("string").alias("level"), "n", "mean", "sd", *[F.col("_q")[k].alias(c) for k, c in enumerate(("median", "q1", "q3"))], "min", "max")
    numbers = numbers.unpivot(["group_name", "field", "level"], list(_STATS), "statistic", "value")
    if not categorical:
        return numbers
    cats = df.select(y, F.explode(F.create_map(*[x for c in categorical for x in (F.lit(c), F.col(c).cast("string"))]))).toDF(y, "field", "level")
    counts = cats.groupingSets([["field", "level"], ["field", "level", y]], "field", "level", y).agg(F.grouping(y).alias("_g"), F.count(F.lit(1)).alias("k")).select(name(F.col("_g")).alias("group_name"), "field", "level", "k")
    groups = F.explode(F.array(F.lit("all"), F.lit("responder"), F.lit("nonresponder"))).alias("group_name")
    every = counts.select("field", "level").distinct().select("field", "level", groups)
    sizes = counts.groupBy("group_name", "field").agg(F.sum("k").alias("_n"))
    full = every.join(counts, ["group_name", "field", "level"], "left").withColumn("k", F.coalesce("k", F.lit(0))).join(sizes, ["group_name", "field"])
    full = full.select("group_name", "field", "level", F.col("k").cast("double").alias("count"), (100 * F.col("k") / F.col("_n")).alias("percent"))
    return numbers.unionByName(full.unpivot(["group_name", "field", "level"], ["count", "percent"], "statistic", "value"))


def pooled_sd(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """by, pooled_sd: the standard deviation within the two groups of y."""
    parts = [F.count_if(F.col(y) == g) for g in (0, 1)], [F.var_samp(F.when(F.col(y) == g, F.col(x))) for g in (0, 1)]
    (n0, n1), (v0, v1) = parts
    return df.groupBy(*by).agg(F.sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / F.nullif(n0 + n1 - 2, F.lit(0))).alias("pooled_sd"))


def two_group_hc3(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """by, difference, se, t: difference of two groups' means and its HC3 standard error in closed form, no fit needed; se and t are null where a group has one row, t where se is 0."""
    cells = [c for g in (0, 1) for c in (F.avg(F.when(F.col(y) == g, F.col(x))).alias(f"_m{g}"), F.var_pop(F.when(F.col(y) == g, F.col(x))).alias(f"_v{g}"), F.count_if(F.col(y) == g).alias(f"_n{g}"))]
    s = df.groupBy(*by).agg(*cells)
    # leverage is 1/n in a group: residuals grow by n / (n - 1)
    term = lambda g: F.col(f"_v{g}") * F.col(f"_n{g}") / F.nullif((F.col(f"_n{g}") - 1) * (F.col(f"_n{g}") - 1), F.lit(0))
    out = s.withColumn("difference", F.col("_m1") - F.col("_m0")).withColumn("se", F.sqrt(term(0) + term(1)))
    return out.select(*by, "difference", "se", (F.col("difference") / F.nullif(F.col("se"), F.lit(0.0))).alias("t"))


def density_grid(df: DataFrame, x: str, by: list[str], points: int = 500, reach: float = 3.0) -> DataFrame:
    """by, g, grid, density: Gaussian kernel density on a fixed number of points, bandwidth 1.06 sd n^(-1/5)."""
    shape = df.groupBy(*by).agg((1.06 * F.stddev_samp(x) * F.pow(F.count(x).cast("double"), F.lit(-0.2))).alias("h"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    # values are combined before they meet the grid
    counts = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_c"))
    met = counts.join(shape, by) if by else counts.crossJoin(F.broadcast(shape))
    lo, hi = F.col("_lo") - reach * F.col("h"), F.col("_hi") + reach * F.col("h")
    met = met.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("grid", lo + (hi - lo) * F.col("g") / F.lit(float(points - 1)))
    z = (F.col("grid") - F.col(x)) / F.col("h")
    return met.groupBy(*by, "g").agg(F.first("grid").alias("grid"), (F.sum(F.exp(-0.5 * z * z) * F.col("_c")) / F.sum("_c") / F.first("h") / F.sqrt(F.lit(6.283185307179586))).alias("density"))


def wilson_table(df: DataFrame, k: str, n: str) -> DataFrame:
    low, high = wilson(F.col(k), F.col(n))
    return df.withColumn("low", low).withColumn("high", high)

