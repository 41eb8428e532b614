"""Tables behind figures and published tables: joins that must match exactly once, and agreement of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import finite, required
from cohortloom.operators.metrics import EDGES_DECIMAL, calibration_bins

#: Versions of one figure may differ by this much.
SAME_VERSION = 1e-12


def matched_once(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """left with columns of right: every row of left has exactly one partner and no row of right is left over, else the query fails."""
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_right"), *[F.first(c).alias(f"_v_{c}") for c in columns])
    marked = left.withColumn("_left", F.lit(1)).join(one, keys, "full")
    ok = F.coalesce((F.col("_left") == 1) & (F.col("_right") == 1), F.lit(False))
    checked = marked.withColumn(keys[0], required(ok, F.col(keys[0]), "rows don't match exactly once"))
    return checked.select(*left.columns, *[F.col(f"_v_{c}").alias(c) for c in columns])


def in_fixed_order(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """place, key, values of the rows named by order, one each; a missing, further or repeated row, and a value that isn't finite, fails."""
    places = rows.sparkSession.createDataFrame([(k, v) for k, v in enumerate(order)], f"place int, {key} string")
    joined = matched_once(places, rows.withColumn(key, F.col(key).cast("string")), [key], values)
    return joined.select("place", key, *[required(finite(F.col(v).cast("double")), F.col(v), f"{v} isn't finite").alias(v) for v in values])


def same_version(computed: DataFrame, supplied: DataFrame, keys: list[str], values: list[str], slack: float = SAME_VERSION) -> DataFrame:
    """computed, if supplied has the same rows with values within slack; else the query fails."""
    names = {v: f"_s_{v}" for v in values}
    both = matched_once(computed, supplied.select(*keys, *[F.col(v).alias(n) for v, n in names.items()]), keys, list(names.values()))
    off = lambda v: F.coalesce(F.abs(F.col(v) - F.col(names[v])) <= slack, F.col(v).isNull() & F.col(names[v]).isNull())
    return both.select(*[required(off(c), F.col(c), f"{c} is of another version").alias(c) if c in names else F.col(c) for c in computed.columns])


def version_faults(computed: DataFrame, supplied: DataFrame, keys: list[str], values: list[str], slack: float = SAME_VERSION) -> DataFrame:
    """One row: keys of either side without one partner, and for each value in how many rows the versions differ."""
    side = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{n}"), *[F.first(v).alias(f"_{n}_{v}") for v in values])
    both = side(computed, 0).join(side(supplied, 1), keys, "full")
    alone = ~F.coalesce((F.col("_n0") == 1) & (F.col("_n1") == 1), F.lit(False))
    off = lambda v: ~F.coalesce(F.abs(F.col(f"_0_{v}") - F.col(f"_1_{v}")) <= slack, F.col(f"_0_{v}").isNull() & F.col(f"_1_{v}").isNull())
    return both.agg(F.count_if(alone).alias("unmatched"), *[F.count_if(~alone & off(v)).alias(f"other_{v}") for v in values])


def model_panel(metrics: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, value, lo, hi: each point estimate with its interval, exactly one each, and well formed.

    metrics: keys, auc, brier; intervals: keys, metric, lo, hi.
    """
    long = metrics.select(*keys, "auc", "brier").unpivot(keys, ["auc", "brier"], "metric", "value")
    return with_interval(matched_once(long, intervals, [*keys, "metric"], ["lo", "hi"]), "value", "lo", "hi")


def with_interval(df: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """df, whose intervals are finite, ordered and around their estimate; else the query fails."""
    return df.withColumn(value, required(~interval_fault(F.col(value), F.col(low), F.col(high)), F.col(value), "an interval must be ordered and contain its estimate"))


def interval_fault(value: Column, low: Column, high: Column) -> Column:
    return ~(finite(value) & finite(low) & finite(high) & F.coalesce((low <= value) & (value <= high), F.lit(False)))


def outside_axis(low: Column, high: Column, limits: tuple[float, float]) -> Column:
    """Whether a mark would be clipped by an axis."""
    return ~(finite(low) & finite(high) & F.coalesce((F.least(low, high) >= limits[0]) & (F.greatest(low, high) <= limits[1]), F.lit(False)))


def display_bins(df: DataFrame, y: str, p: str, by: list[str], bins: int = 5) -> DataFrame:
    """The five calibration bins for display, where an empty one fails."""
    out = calibration_bins(df, y, p, by, EDGES_DECIMAL)
    full = out.groupBy(*by).agg(F.count(F.lit(1)).alias("_k")) if by else out.agg(F.count(F.lit(1)).alias("_k"))
    joined = out.join(full, by) if by else out.crossJoin(full)
    return joined.withColumn("n", required((F.col("_k") == bins) & (F.col("n") > 0), F.col("n"), "a calibration bin is empty")).drop("_k")


def region_effects(effects: DataFrame, groups: DataFrame, region: str, value: str) -> DataFrame:
    """group, region, value: the one effect of each region that a display group names (groups: group, region)."""
    return matched_once(groups, effects.join(groups.select(region).distinct(), region, "left_semi"), [region], [value]).select("group", region, required(finite(F.col(value)), F.col(value), "an effect isn't finite").alias(value))


def provenance_faults(ids: DataFrame, saved_ids: DataFrame, regions: DataFrame, saved_regions: DataFrame, digest: str, saved_digest: str) -> DataFrame:
    """One row: places at which ids and regions (place, name) differ from those saved with a result, and whether the input's digest does."""

    def differing(a: DataFrame, b: DataFrame, out: str) -> DataFrame:
        return a.select("place", F.col("name").alias("a")).join(b.select("place", F.col("name").alias("b")), "place", "full").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias(out))

    both = differing(ids, saved_ids, "other_ids").crossJoin(differing(regions, saved_regions, "other_regions"))
    return both.withColumn("other_digest", F.lit(digest != saved_digest))


def frequencies(df: DataFrame, by: list[str], choices: list[str]) -> DataFrame:
    """by, choices, n, share: how often each combination was chosen."""
    counts = df.groupBy(*by, *choices).agg(F.count(F.lit(1)).alias("n"))
    totals = df.groupBy(*[F.col(c).alias(f"_t_{c}") for c in by]).agg(F.count(F.lit(1)).alias("_all"))
    on = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by]
    return (counts.join(totals, on) if by else counts.crossJoin(totals)).select(*by, *choices, "n", (F.col("n") / F.col("_all")).alias("share"))


def sign_fractions(coefficients: DataFrame, by: list[str], value: str, slack: float = 0.0) -> DataFrame:
    """by, n, negative, zero, positive: fractions of the coefficients' signs; within slack of 0 counts as 0."""
    v = F.col(value)
    share = lambda c, name: F.avg(c.cast("double")).alias(name)
    return coefficients.groupBy(*by).agg(F.count(value).alias("n"), share(v < -slack, "negative"), share(F.abs(v) <= slack, "zero"), share(v > slack, "positive"))


def performance_table(metrics: DataFrame, intervals: DataFrame, order: list[str]) -> DataFrame:
    """model, place, metric, shown (`0.712 (0.601 to 0.823)`) in the models' fixed order."""
    panel = model_panel(metrics, intervals, ["model"])
    places = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model")) - 1
    shown = lambda c: F.round(F.col(c).cast("decimal(38,12)"), 3).cast("string")
    return panel.select("model", required(places >= 0, places, "a model isn't in the table's order").cast("int").alias("place"), "metric", F.concat(shown("value"), F.lit(" ("), shown("lo"), F.lit(" to "), shown("hi"), F.lit(")")).alias("shown"))
