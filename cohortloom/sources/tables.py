"""Strict sources: schemas are given, never inferred; faults fail, nothing is dropped."""

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.columns import required
from cohortloom.operators.contracts import ContractError, key_rules, require


def keyed_csv(spark: SparkSession, path: str, schema: str, key: str = "study_id", check: bool = True) -> DataFrame:
    """A CSV (or TSV, by suffix) with header whose key is complete, unique and alphanumeric; other columns as the schema says."""
    df = spark.read.schema(schema).option("sep", "\t" if path.endswith(".tsv") else ",").option("mode", "FAILFAST").option("enforceSchema", "false").csv(path, header=True)
    if check:
        faults = key_rules(df, key).first().asDict()
        bad = {k: v for k, v in faults.items() if k != "n_rows" and v}
        if bad:
            raise ContractError(f"{key}: {bad}")
    return df


def with_file_order(df: DataFrame, position: str = "row_pos") -> DataFrame:
    """df of one small file with its row order as an explicit column (the file is read by one task)."""
    n = len(df.columns)
    rdd = df.coalesce(1).rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
    return df.sparkSession.createDataFrame(rdd, T.StructType([*df.schema.fields[:n], T.StructField(position, T.LongType(), False)]))


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ContractError("a JSON object repeats a key")
    return out


def _no_constant(name: str):
    raise ContractError(f"JSON holds {name}")


def parse_json(text: str):
    """Strict JSON: a byte-order mark is dropped; repeated keys, NaN and infinities are refused."""
    found = json.loads(text.removeprefix("﻿"), object_pairs_hook=_unique, parse_constant=_no_constant)
    _check_finite(found)
    return found


def _check_finite(x) -> None:
    if isinstance(x, float) and not math.isfinite(x):
        raise ContractError("JSON holds a number beyond double range")
    for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        _check_finite(v)


def json_documents(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """path, document: whole JSON files under a schema. strict: texts pass parse_json first, in their tasks."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    if strict:
        @F.pandas_udf("string")
        def checked(t: pd.Series) -> pd.Series:
            return t.map(lambda v: json.dumps(parse_json(v)))

        texts = texts.withColumn("value", checked("value"))
    return texts.select("path", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("document"))


def json_objects(text: Column) -> Column:
    """error of a strict parse of each JSON object text (null: fine): repeated keys, non-objects, non-finite numbers."""
    @F.pandas_udf("string")
    def fault(t: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if isinstance(parse_json(v), dict) else "not an object"
            except (ValueError, TypeError) as e:
                return str(e) or type(e).__name__

        return t.map(one)

    return fault(text)


def manifest_rows(document: dict) -> list[dict]:
    """Rows of a manifest envelope: schema_version is the integer 1, rows a non-empty list of objects."""
    version, rows = document.get("schema_version"), document.get("rows")
    if type(version) is not int or version != 1 or not isinstance(rows, list) or not rows or not all(isinstance(r, dict) for r in rows):
        raise ContractError("not a manifest of version 1 with rows")
    return rows


def review_decisions(df: DataFrame, subject: str, field: str, accepted: tuple[str, ...] = ("PASS", "PASS_WITH_ATTENTION")) -> str:
    """The subject's one decision, which must be an accepted one; the key is subject, study_id or participant_id."""
    key = next((c for c in ("subject", "study_id", "participant_id") if c in df.columns), None)
    if key is None or field not in df.columns:
        raise ContractError("the decision table lacks its key or field")
    rows = df.where(F.trim(F.col(key)) == subject).select(F.upper(F.trim(F.col(field)))).limit(2).collect()
    if len(rows) != 1 or rows[0][0] not in accepted:
        raise ContractError(f"{subject} has no single accepted decision")
    return rows[0][0]


def feature_files(df: DataFrame, containers: tuple[str, ...], key: str = "study_id") -> DataFrame:
    """key, features (map) from rows with several optional containers: the first that is there; one row a key."""
    picked = df.select(key, F.coalesce(*[F.col(c) for c in containers]).alias("features"))
    picked = require(picked, {"no_features": F.col("features").isNull()})
    return picked.withColumn("features", required(F.count(F.lit(1)).over(_by(key)) == 1, F.col("features"), "a key has several files"))


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def selection_manifest(df: DataFrame) -> DataFrame:
    """Reviewed rows of a series selection (all strings): a row without review, or with an unreviewed patch, fails; nothing is guessed."""
    passed = F.upper(F.trim("review_pass")).isin("PASS", "TRUE", "YES", "1")
    patched = F.coalesce(F.trim("pet_metadata_patch_json"), F.lit("")) != ""
    reviewed = F.upper(F.coalesce(F.trim("metadata_patch_reviewed"), F.lit(""))).isin("PASS", "TRUE", "YES", "1")
    return require(df, {"not_reviewed": ~passed, "patch_not_reviewed": patched & ~reviewed, "empty_source": F.coalesce(F.trim("source_nii"), F.lit("")) == "", "empty_target": F.coalesce(F.trim("target_nii"), F.lit("")) == ""})


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def scanner_metadata(spark: SparkSession, path: str, needed: tuple[str, ...] = ("study_id", "scanner"), optional: tuple[str, ...] = ("epilepsy_type",)) -> DataFrame:
    """The needed columns and those of the optional ones that are there, as plain strings: words like NA stay words, all else is left behind."""
    head = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\x00").csv(path)
    if not set(needed) <= set(head.columns):
        raise ContractError(f"columns {sorted(set(needed) - set(head.columns))} are missing")
    return head.select(*needed, *[c for c in optional if c in head.columns])


def array_bundle(spark: SparkSession, path: str, name: str) -> DataFrame:
    """row_pos, values of one matrix of a NumPy bundle, to be kept as Parquet; objects in it are refused."""
    import numpy as np

    with np.load(path, allow_pickle=False) as bundle:
        rows = np.atleast_2d(np.asarray(bundle[name], float))
    if not np.isfinite(rows).all():
        raise ContractError(f"{name} holds non-finite numbers")
    return spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "row_pos long, values array<double>")


def feature_config(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """regions (label, side, node, composite) and references (reference, label) of a regional configuration document.

    The document has `composites` (name to list of nodes), `nodes` (name to {left, right} label ids) and
    `references` (name to label ids); a node in no or several composites, and a label of two nodes, fail.
    """
    raw = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small document
    document = parse_json(raw)
    if not isinstance(document, dict) or set(document) != {"composites", "nodes", "references"}:
        raise ContractError("a configuration has composites, nodes and references")
    of = [(node, c) for c, nodes in document["composites"].items() for node in nodes]
    if sorted(n for n, _ in of) != sorted(document["nodes"]):
        raise ContractError("every node must be in exactly one composite")
    sides = [(int(label), side, node, dict(of)[node]) for node, pair in document["nodes"].items() for side, label in (("L", pair["left"]), ("R", pair["right"]))]
    if len({s[0] for s in sides}) != len(sides):
        raise ContractError("a label belongs to two nodes")
    references = [(r, int(label)) for r, labels in document["references"].items() for label in labels]
    return {"regions": spark.createDataFrame(sides, "label int, side string, node string, composite string"), "references": spark.createDataFrame(references, "reference string, label int")}


def model_input(document: dict, columns: list[str], outcome: str = "outcome") -> dict:
    """A model-input document with unique string ids, a row of the given columns for each, and outcomes of 0 or 1; else an error."""
    ids, rows, y = document.get("participant_ids"), document.get("rows"), document.get(outcome)
    if not (isinstance(ids, list) and isinstance(rows, list) and isinstance(y, list) and len(ids) == len(rows) == len(y) > 1):
        raise ContractError("ids, rows and outcomes must be lists of one length")
    if len(set(ids)) != len(ids) or not all(isinstance(i, str) and i for i in ids):
        raise ContractError("ids must be unique strings")
    if any(type(v) is not int or v not in (0, 1) for v in y) or any(set(r) != set(columns) for r in rows):
        raise ContractError("outcomes must be 0 or 1 and rows have exactly the model's columns")
    if "plan" in document:
        _check_plan(document["plan"], len(ids), y)
    return document


def _check_plan(plan, n: int, y: list[int]) -> None:
    """A saved nested plan: every repeat tests each person once, training is the rest, inner parts split the training rows, both classes everywhere."""

    def positions(x) -> set:
        if not isinstance(x, list) or any(type(v) is not int or not 0 <= v < n for v in x) or len(set(x)) != len(x):
            raise ContractError("a plan's positions must be distinct integers of the cohort")
        if not x:
            raise ContractError("a part of a plan has no one in it")
        return set(x)

    everyone, tested, named = set(range(n)), {}, set()
    if not isinstance(plan, list) or not plan:
        raise ContractError("a plan is a list of splits")
    for split in plan:
        if not isinstance(split, dict) or set(split) != {"repeat", "fold", "train", "test", "inner_seed", "inner"} or any(type(split[k]) is not int or split[k] < 0 for k in ("repeat", "fold", "inner_seed")):
            raise ContractError("a split has repeat, fold, train, test, inner_seed and inner")
        if (split["repeat"], split["fold"]) in named:
            raise ContractError("a repeat has a fold twice")
        named.add((split["repeat"], split["fold"]))
        train, test = positions(split["train"]), positions(split["test"])
        if train | test != everyone or train & test:
            raise ContractError("train and test must divide the cohort")
        if tested.setdefault(split["repeat"], set()) & test:
            raise ContractError("a person is tested twice in a repeat")
        tested[split["repeat"]] |= test
        seen: set = set()
        for pair in split["inner"]:
            fit, check = positions(pair["train"]), positions(pair["validation"])
            if fit | check != train or fit & check or seen & check:
                raise ContractError("inner parts must divide the training rows, each validated once")
            seen |= check
            if any(len({y[k] for k in part}) < 2 for part in (fit, check)):
                raise ContractError("an inner part has one class")
        if seen != train:
            raise ContractError("inner parts must validate every training row")
    if any(t != everyone for t in tested.values()):
        raise ContractError("a repeat doesn't test everyone")
    repeats, folds = (1 + max(x[k] for x in named) for k in (0, 1))
    if len(named) != repeats * folds or len({len(split["inner"]) for split in plan}) != 1:
        raise ContractError("a plan has the same folds, from 0 on, in each of its repeats, from 0 on, and as many inner parts in each")


#: Categorical columns of the metadata and their names in the first table.
FIRST_TABLE = {"epilepsy_type": "epilepsy_classification", "etiology_detailed": "etiology_group", "scanner_source_key": "scanner"}


def first_table(cohort: DataFrame, metadata: DataFrame, frequency: str = "log1p_baseline_monthly_frequency") -> DataFrame:
    """Rows of the descriptive table: the cohort's columns, its categories from the metadata (strings by study_id), and the frequency that the logarithm was made of.

    People of the metadata alone are left out; a person twice in it, one of the cohort who isn't in it, and an empty or missing category fail.
    """
    if metadata.groupBy("study_id").count().where("count > 1 or study_id is null").limit(1).count():
        raise ContractError("metadata needs one row for each study_id")
    told = metadata.select("study_id", *[F.col(c).alias(f"_{n}") for c, n in FIRST_TABLE.items()], F.lit(True).alias("_there"))
    met = cohort.join(told, "study_id", "left")
    there = lambda n: required(F.coalesce(F.col("_there"), F.lit(False)), required(F.coalesce(F.col(f"_{n}") != "", F.lit(False)), F.col(f"_{n}"), f"{n} has no value"), "a person of the cohort has no metadata").alias(n)
    return met.select(*cohort.columns, *[there(n) for n in FIRST_TABLE.values()], F.expm1(frequency).alias("baseline_monthly_frequency_reconstructed"))
