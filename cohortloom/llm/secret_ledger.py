"""Secret scans over a ledger of content-addressed blobs, with DataFrame functions only.

Every version of a text is a blob, addressed by its SHA-256. A ledger folder
holds what has been scanned, as (blob, rule_version, run), the findings of each
run, and the paths of each version that was committed. A scan first finds the
blobs without a ledger row under the rule version, by their addresses alone, and
writes that list; then one text of each of them is dealt to a task: copies are
dropped in the tasks that read them, before the shuffle. Findings are joined back
to every path of every version. Findings are written before the ledger rows that
vouch for them, so a run that dies leaves findings that no ledger row names, and
the next run scans those blobs again.

Defined results: null text is the empty blob; null and repeated doc_ids are
paths like any other; an empty table gives an empty result; a version that is
committed twice has its paths twice; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime

#: The rules' fixed values: kind, pattern, group whose length counts, fewest characters.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
RULE_VERSION = "base-1"
LEDGER = "blob string, rule_version string, run string"
FINDINGS = "blob string, rule_version string, run string, rank int, start long, end long"


def _pattern(kind: str, pattern: str, fewest: int) -> str:
    """Short runs of one class can't overlap a long one, so only long ones need be matched."""
    return {"access": f"AKIA[A-Z0-9]{{{fewest - 4},}}", "hex": f"[0-9a-f]{{{fewest},}}"}.get(kind, pattern)


def _worth(kind: str, text: Column) -> Column:
    """False only where the kind's pattern can't match: a search for fixed strings is cheaper."""
    if kind == "assign":
        low = F.lower(text)
        return low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    return text.contains("AKIA") if kind == "access" else F.lit(True)


def scan(blobs: DataFrame) -> DataFrame:
    """blob, rank (of the kind in RULES), start, end (code points, end exclusive) of each finding in blob, text.

    A text's gaps between matches and its matches are split off by the same
    pattern; running sums of their lengths give the places.
    """
    df, kinds = blobs.select("blob", "text"), []
    for rank, (kind, pattern, group, fewest) in enumerate(RULES):
        p = F.lit(_pattern(kind, pattern, fewest))
        df = df.withColumn(kind, F.when(_worth(kind, F.col("text")), F.regexp_extract_all("text", p, F.lit(0))))
    some = F.lit(False)
    for kind, *_ in RULES:
        some = some | (F.coalesce(F.size(kind), F.lit(0)) > 0)
    df = df.where(some)
    for rank, (kind, pattern, group, fewest) in enumerate(RULES):
        p = _pattern(kind, pattern, fewest)
        counted = F.regexp_extract_all("text", F.lit(p), F.lit(group)) if group else F.col(kind)
        parts = F.arrays_zip(F.slice(F.split("text", p, -1), 1, F.size(kind)).alias("gap"), F.col(kind).alias("hit"), counted.alias("value"))
        sizes = F.transform(parts, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["value"]).alias("value")))
        kinds.append(F.struct(F.lit(rank).alias("rank"), F.when(F.size(kind) > 0, sizes).otherwise(F.array().cast("array<struct<gap:int,hit:int,value:int>>")).alias("at")))
    rows = df.select("blob", F.explode(F.array(*kinds)).alias("k")).select("blob", "k.rank", F.posexplode("k.at"))
    so_far = Window.partitionBy("blob", "rank").orderBy("pos")
    rows = rows.withColumn("end", F.sum((F.col("col.gap") + F.col("col.hit")).cast("long")).over(so_far))
    fewest = F.element_at(F.array(*[F.lit(r[3]) for r in RULES]), F.col("rank") + 1)
    return rows.where(F.col("col.value") >= fewest).select("blob", "rank", (F.col("end") - F.col("col.hit")).alias("start"), "end")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    fs, at = runtime._hadoop(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(at) else spark.createDataFrame([], schema)


def update(blobs: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans the rows of blobs (blob, text) that the ledger folder doesn't have under rule_version, and records them; returns the blobs scanned."""
    spark = blobs.sparkSession
    run = uuid.uuid4().hex
    seen = _table(spark, f"{ledger}/scanned", LEDGER).where(F.col("rule_version") == rule_version).select("blob").distinct()
    tag = [F.lit(rule_version).alias("rule_version"), F.lit(run).alias("run")]
    unseen = runtime.written(blobs.select("blob").distinct().join(seen, "blob", "left_anti").select("blob", *tag), f"{ledger}/unseen", run)
    if unseen.isEmpty():
        return unseen.select("blob")
    # one row a blob and task goes to the shuffle; few unseen blobs are broadcast, and then other texts aren't shuffled at all
    one = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(runtime.if_small(unseen.select("blob")), "blob", "left_semi")
    scan(one).select("blob", *tag, "rank", "start", "end").write.mode("append").parquet(f"{ledger}/findings")
    unseen.write.mode("append").parquet(f"{ledger}/scanned")
    return unseen.select("blob")


def findings(spark: SparkSession, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """blob, rank, start, end that the ledger vouches for."""
    vouched = _table(spark, f"{ledger}/scanned", LEDGER).where(F.col("rule_version") == rule_version)
    found = _table(spark, f"{ledger}/findings", FINDINGS).where(F.col("rule_version") == rule_version)
    return found.join(vouched, ["blob", "rule_version", "run"], "left_semi").select("blob", "rank", "start", "end").distinct()


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


PATHS = "version string, doc_id {}, blob string"


def commit(docs: DataFrame, ledger: str, version: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Records the paths of a version of the corpus and scans the blobs that no version before it had; returns those."""
    named = runtime.only(docs).select("doc_id", blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    named.select(F.lit(version).alias("version"), "doc_id", "blob").write.mode("append").parquet(f"{ledger}/paths")
    return update(named.select("blob", "text"), ledger, rule_version)


def paths(spark: SparkSession, ledger: str, id_type: str = "long") -> DataFrame:
    """version, doc_id, blob of every path of every version."""
    return _table(spark, f"{ledger}/paths", PATHS.format(id_type))


def spans_of(spark: SparkSession, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """blob, spans of every blob with findings. spans: array of (start, rank, end), in order."""
    return findings(spark, ledger, rule_version).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias("spans"))


def scan_documents(docs: DataFrame, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob of every row; blob, spans of every blob with findings), with a ledger of its own if none is given."""
    spark = docs.sparkSession
    folder = runtime.work_folder(spark, "secrets")
    ledger = ledger or f"{folder}/ledger"
    named = runtime.only(docs).select("doc_id", blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    update(named.select("blob", "text"), ledger)
    return named.select("doc_id", "blob"), runtime.written(spans_of(spark, ledger), folder, "spans")


#: Spans of 20 bytes that a broadcast table of findings has at most.
BROADCAST_SPANS = 200_000


def redact(docs: DataFrame, mark: str = "[SECRET]", ledger: str | None = None) -> DataFrame:
    """docs with each stretch of overlapping findings in text replaced by mark; n_chars, where there is one, follows."""
    _, spans = scan_documents(docs, ledger)
    blob, at = runtime.fresh("blob", docs), runtime.fresh("spans", docs)
    size = spans.agg(F.coalesce(F.sum(F.size("spans") + 4), F.lit(0))).first()[0]  # an address is as large as a few spans
    spans = spans.select(F.col("blob").alias(blob), F.col("spans").alias(at))
    joined = docs.withColumn(blob, blob_of(docs["text"])).join(F.broadcast(spans) if size <= BROADCAST_SPANS else spans, blob, "left")
    # where each stretch begins and how far all findings before it reach
    reach, text = runtime.fresh("reach", joined), F.col("text")
    far = F.aggregate(F.col(at), F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.greatest(F.element_at(a, -1), x["end"])))
    joined = joined.withColumn(reach, far)
    new = F.filter(F.transform(F.col(at), lambda x, k: F.struct(x["start"].alias("start"), F.get(F.col(reach), k).alias("before"), k.alias("k"))), lambda x: (x["start"] >= x["before"]))
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    head = F.array_join(F.transform(new, lambda x: F.concat(cut(x["before"], x["start"]), F.lit(mark))), "")
    last = F.element_at(F.col(reach), -1)
    clean = F.when(F.col(at).isNull(), text).otherwise(F.concat(head, cut(last, F.length(text).cast("long"))))
    out = {"text": clean}
    joined = joined.withColumns(out)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(at).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return joined.select(*[joined[c] for c in docs.columns])
