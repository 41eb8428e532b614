"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Statistics are computed within a row: no text leaves its task. Outliers are
judged by minimum-covariance-determinant (MCD) estimates for each language and
source. The estimates come from concentration steps ("C-steps"): each step is
one aggregation of sufficient statistics by (group, start, distance bin), with
map-side combining, so that a source with a third of all rows costs one small
partial row for each bin and task. Every group has an estimate of its own: its
moments are joined by PRIOR_ROWS rows' worth of those of its parent (language
and source: the language; language: all rows), so that a group of a few rows
leans on its parent and a large one on itself, without a size at which the rule
changes. The group tables hold |languages| x |sources| rows.

Defined results: null text has no words and fails; null language or source is a
group of its own (shared with the empty string); an empty table gives an empty
result; repeated rows are judged alike; a distance of exactly the limit is kept;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

#: The rule's fixed values.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 20
REPEAT_SPAN = 8
MAX_REPEAT_PERCENT = 30

#: The transformed vector and, for each entry, the scale below which spread counts as none. The shares of
#: repeated lines and words end at 1 and 0.3: their floors let each of them reject alone, from about 1/3 and 0.21 on.
VECTOR = ("ln_word_length", "root_symbols", "root_dup_lines", "root_repeats")
FLOORS = (0.05, 0.05, 0.1, 0.08)
DIM = len(VECTOR)

COVERAGE = 0.75
C_STEPS = 6
#: Rows' worth of its parent's moments that a group's own moments are joined by.
PRIOR_ROWS = 100
REJECT_TAIL = 1e-6
#: Quantiles are of entries rounded down to multiples of 1 / GRID: exact counts of few values, whatever the order of merging.
GRID = 256
BINS_PER_E = 32


def _chi2_tail(x: float, dof: int) -> float:
    """P(chi-square > x) for an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return total


def _chi2_above(tail: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_tail(mid, dof) > tail else (low, mid)
    return low


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (longs)."""
    body = F.coalesce(F.col(text), F.lit(""))
    # one column for each step: Spark keeps a step that is used twice as a projection of its own
    df = docs.withColumn("_parts", F.split(body, rf"{SPACE}+", -1))
    # only the first and the last part can be empty
    first = (F.element_at("_parts", 1) == "").cast("int")
    last = ((F.size("_parts") > 1) & (F.element_at("_parts", -1) == "")).cast("int")
    df = df.withColumn("_words", F.when(first + last == 0, F.col("_parts")).otherwise(F.slice("_parts", first + 1, F.size("_parts") - first - last)))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    # hashes of one word, then of two, four and eight in a row
    pairs = lambda x, k: F.zip_with(x, F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    known = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  f of x, which is computed once
    eight = known(F.transform("_words", lambda w: F.xxhash64(w)), lambda one: known(pairs(one, 1), lambda two: known(pairs(two, 2), lambda four: pairs(four, 4))))
    df = df.withColumn("_spans", F.when(F.col("n_words") >= REPEAT_SPAN, F.slice(eight, 1, F.col("n_words").cast("int") - REPEAT_SPAN + 1)).otherwise(F.array().cast("array<bigint>")))
    # most texts repeat no span; only the others are sorted
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_spans")) < F.size("_spans"),
            F.sort_array(F.transform("_spans", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda x, k: F.coalesce(F.get("_sorted", k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_starts", lambda p, k: F.least(F.lit(REPEAT_SPAN), F.coalesce(F.get("_starts", k + 1) - p, F.lit(REPEAT_SPAN)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    df = df.withColumn("_lines", F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return (
        df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(body, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("_parts", "_words", "_spans", "_sorted", "_starts", "_lines")
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vector(df: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    entries = (F.ln(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), ratio("n_symbols", "word_chars"), ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"))
    return df.withColumns({f"x{k}": e for k, e in enumerate(entries)})


def _groups() -> Column:
    """A row's groups with their parents, finest first: language and source, language, all (whose parent is null)."""
    lang, source = F.coalesce(F.col("lang"), F.lit("")), F.coalesce(F.col("source"), F.lit(""))
    names = [F.to_json(F.struct(lang.alias("l"), source.alias("s"))), F.to_json(F.struct(lang.alias("l"))), F.lit("{}"), F.lit(None).cast("string")]
    return F.array(*[F.struct(names[k].alias("g"), names[k + 1].alias("parent")) for k in range(3)])


PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


# The algebra below is written as SQL text: a call for each expression, not for each of its terms.


def _factored(shape: DataFrame) -> DataFrame:
    """shape (m0.., covariances v_ij) with the Cholesky factor l_ij and ln_det; spread below FLOORS counts as FLOORS."""
    entries = []
    for i, j in PAIRS:  # one entry after the other, in one projection: each is a column that the next ones use
        known = " - ".join([f"(v{i}{j} + {FLOORS[i] ** 2 if i == j else 0.0}D)", *[f"l{i}{k} * l{j}{k}" for k in range(j)]])
        entries.append(f"sqrt({known}) as l{i}{j}" if i == j else f"({known}) / l{j}{j} as l{i}{j}")
    return shape.selectExpr("*", *entries, " + ".join(f"2 * ln(l{i}{i})" for i in range(DIM)) + " as ln_det")


def _distance(df: DataFrame) -> DataFrame:
    entries = ["(" + " - ".join([f"x{i}", f"m{i}", *[f"l{i}{k} * y{k}" for k in range(i)]]) + f") / l{i}{i} as y{i}" for i in range(DIM)]
    return df.selectExpr("*", *entries, " + ".join(f"y{i} * y{i}" for i in range(DIM)) + " as d2")


SHAPE = [f"m{i}" for i in range(DIM)] + [f"v{i}{j}" for i, j in PAIRS]
SUMS = ["n", *[f"s{i}" for i in range(DIM)], *[f"p{i}{j}" for i, j in PAIRS]]


def _moments() -> list[Column]:
    return [F.expr(x) for x in ("cast(count(1) as double) as n", *[f"sum(x{i}) as s{i}" for i in range(DIM)], *[f"sum(x{i} * x{j}) as p{i}{j}" for i, j in PAIRS])]


def _shape(df: DataFrame, factor: float = 1.0) -> DataFrame:
    """Means and covariances (times factor) of the sums in df."""
    return df.selectExpr("*", *[f"s{i} / n as m{i}" for i in range(DIM)], *[f"(p{i}{j} / n - s{i} * s{j} / n / n) * {factor!r}D as v{i}{j}" for i, j in PAIRS])


def _leaning(own: DataFrame, before: DataFrame) -> DataFrame:
    """own's groups (g, parent, start, size, n and their shape), joined by PRIOR_ROWS rows' worth of their parent's shape in `before`."""
    up = before.selectExpr("g as parent", "start", f"struct({', '.join(SHAPE)}) as up")
    both = own.join(up, ["parent", "start"], "left").selectExpr("g", "start", "size", *SHAPE, f"coalesce(up, struct({', '.join(SHAPE)})) as up", f"n / (n + {PRIOR_ROWS}D) as w")
    mean = [f"w * m{i} + (1 - w) * up.m{i} as m{i}" for i in range(DIM)]
    cov = [f"w * v{i}{j} + (1 - w) * up.v{i}{j} + w * (1 - w) * (m{i} - up.m{i}) * (m{j} - up.m{j}) as v{i}{j}" for i, j in PAIRS]
    return both.selectExpr("g", "start", "size", *mean, *cov)


def estimates(stats: DataFrame, folder: str) -> DataFrame:
    """MCD location and factor for each group (language and source, language, all) of rows that pass the base rules.

    stats: a written table of lang, source and x0..; two deterministic starts
    (medians with interquartile scales; mean and covariance of all rows), C_STEPS
    concentration steps each, the smaller determinant wins.
    """
    rows = stats.select(F.explode(_groups()).alias("_group"), *[f"x{i}" for i in range(DIM)]).select("_group.*", *[f"x{i}" for i in range(DIM)])
    quantiles = [F.expr(f"percentile(floor(x{i} * {GRID}) / {GRID}, array(0.25, 0.5, 0.75)) as q{i}") for i in range(DIM)]
    spread = rows.groupBy("g", "parent").agg(*quantiles, *_moments())
    spread = runtime.written(spread.withColumn("size", F.col("n")), folder, "spread")
    # a row a group and start: broadcast unless there are very many languages and sources; beyond, Spark splits the joins' hot keys
    sized = F.broadcast if spread.count() <= runtime.BROADCAST_ROWS else lambda df: df
    whole = _shape(spread).withColumn("start", F.lit(1))
    middle = spread.selectExpr("*", *[f"q{i}[1] as m{i}" for i in range(DIM)], *[f"power((q{i}[2] - q{i}[0]) / 1.349D, 2) as v{i}{j}" if i == j else f"0D as v{i}{j}" for i, j in PAIRS], "0 as start")
    about = ["g", "parent", "start", "size", "n", *SHAPE]
    own = runtime.written(middle.select(*about).unionByName(whole.select(*about)), folder, "own")
    params = runtime.written(_factored(_leaning(own, sized(own))), folder, "params0")
    in_order = Window.partitionBy("g", "start").orderBy("bin")
    half = _chi2_above(1 - COVERAGE, DIM)
    factor = COVERAGE / (1 - _chi2_tail(half, DIM + 2))
    for step in range(1, C_STEPS + 1):
        near = _distance(rows.join(sized(params.drop("ln_det", *[f"v{i}{j}" for i, j in PAIRS])), "g"))
        binned = near.groupBy("g", "parent", "start", "size", F.floor(F.ln(F.col("d2") + 1e-6) * BINS_PER_E).alias("bin")).agg(*_moments())
        # bins are taken up to the one in which the count reaches the coverage
        kept = binned.withColumn("before", F.sum("n").over(in_order) - F.col("n")).where(F.col("before") < COVERAGE * F.col("size"))
        sums = kept.groupBy("g", "parent", "start", "size").agg(*[F.expr(f"sum({c}) as {c}") for c in SUMS])
        # a step leans on its parents' shapes of the step before
        params = runtime.written(_factored(_leaning(_shape(sums, factor), sized(params))), folder, f"params{step}")
    best = Window.partitionBy("g").orderBy("ln_det", "start")
    return params.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "start", "size", "ln_det", *[f"v{i}{j}" for i, j in PAIRS])


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), lang, source, the statistics, base_failed, distance (null
    where no row of the language and source passes the base rules) and kept, one row for each row of docs."""
    spark = docs.sparkSession
    folder = runtime.work_folder(spark, "quality")
    have = {c: F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    named = docs.select("doc_id", F.col(text).alias("text"), *[x.cast("string").alias(c) for c, x in have.items()])
    stats = _vector(statistics(named)).withColumn("base_failed", base_failed()).withColumn("text_key", F.xxhash64("text")).drop("text")
    stats = runtime.written(stats, folder, "stats")
    fine = runtime.if_small(runtime.written(estimates(stats.where(~F.col("base_failed")), folder), folder, "fine"))
    judged = stats.withColumn("g", _groups()[0]["g"]).join(fine, "g", "left")
    limit = _chi2_above(REJECT_TAIL, DIM)
    judged = _distance(judged).withColumn("distance", F.col("d2")).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(True)))
    return runtime.settled(judged.select(*stats.columns, "distance", "kept"), folder, "quality-verdicts")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that assess() keeps, with the columns of docs; rows that repeat share their verdict."""
    id_, key = runtime.fresh("rejected_id", docs), runtime.fresh("rejected_key", docs)
    bad = assess(docs).where(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    bad = runtime.written(bad, runtime.work_folder(docs.sparkSession, "rejected"), "rows")
    return docs.join(runtime.if_small(bad), docs["doc_id"].eqNullSafe(bad[id_]) & (F.xxhash64(docs["text"]) == bad[key]), "left_anti")
