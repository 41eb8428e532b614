"""Sinks: fresh targets, finite numbers, digests."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from cohortloom.operators.contracts import ContractError


def nullable(df: DataFrame) -> DataFrame:
    """NaN and infinities of number columns as nulls."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType | FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in floats})


def write_json(df: DataFrame, path: str, finite: str = "null") -> None:
    """JSON lines to a fresh target; non-finite numbers as null, or with finite="raise" an error."""
    clean = nullable(df)
    if finite == "raise":
        lost = df.agg(*[F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c, t in df.dtypes if t in ("double", "float")] or [F.lit(0).alias("_")]).first()
        if any(lost):
            raise ContractError("the table holds non-finite numbers")
    clean.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with header in the given order, to a fresh target; for result tables."""
    df.orderBy(*order).coalesce(1).write.mode("errorifexists").csv(path, header=True)


def fresh_target(target: str, protected: list[str]) -> str:
    """target, if it is neither within, nor around, nor the same as a protected root."""
    t = PurePosixPath(target)
    for root in map(PurePosixPath, protected):
        if t == root or root in t.parents or t in root.parents:
            raise ContractError(f"{target} overlaps {root}")
    return target


def document_json(x):
    """A document ready for JSON: arrays as lists, non-finite numbers as null."""
    if isinstance(x, dict):
        return {str(k): document_json(v) for k, v in x.items()}
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list | tuple):
        return [document_json(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def digest(document) -> str:
    """SHA-256 of a document's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def freeze(paths: list[str], document: dict) -> dict:
    """A manifest of files and a document, to be verified before its results are used."""
    return {"schema_version": 1, "rows": [{"path": p, "sha256": hashlib.sha256(open(p, "rb").read()).hexdigest()} for p in sorted(paths)], "document_sha256": digest(document)}


def verify(manifest: dict, document: dict) -> None:
    if freeze([r["path"] for r in manifest["rows"]], document) != manifest:
        raise ContractError("a frozen file or document has changed")


def write_arrays(spark, path: str, arrays: dict) -> None:
    """Named NumPy arrays as one Parquet table (name, kind, shape, values) at a fresh target; objects and non-finite numbers are refused."""
    import numpy as np

    rows = []
    for name, a in arrays.items():
        a = np.asarray(a)
        if a.dtype.kind not in "fiub" or not np.isfinite(a.astype(float)).all():
            raise ContractError(f"{name} must be an array of finite numbers")
        rows.append((name, a.dtype.str, list(a.shape), a.astype(float).ravel().tolist()))
    spark.createDataFrame(rows, "name string, kind string, shape array<long>, values array<double>").coalesce(1).write.mode("errorifexists").parquet(path)


def read_arrays(spark, path: str) -> dict:
    """The arrays that write_arrays() wrote."""
    import numpy as np

    return {r.name: np.array(r["values"]).astype(np.dtype(r.kind)).reshape(r.shape) for r in spark.read.parquet(path).collect()}


def payload(document) -> dict:
    """A copy of a display document as JSON would give it back: text keys, plain numbers, no number that isn't finite."""
    if not isinstance(document, dict):
        raise ContractError("a payload is an object")
    try:
        return json.loads(json.dumps(document_json(document), allow_nan=False, sort_keys=True))
    except ValueError as e:
        raise ContractError(f"a payload can't be written: {e}") from e


def status_document(path: str, spark, run) -> dict:
    """Runs run() and leaves a status document beside its output, whether it passes or fails; a failure is raised after that."""
    import time

    began, error = time.time(), None
    try:
        run()
        status = {"status": "PASS"}
    except Exception as e:  # noqa: BLE001  kept in the document and raised again
        error, status = e, {"status": "FAILED", "error": f"{type(e).__name__}: {e}"}
    status |= {"schema_version": 1, "elapsed_seconds": round(time.time() - began, 3)}
    spark.createDataFrame([(json.dumps(status, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    if error is not None:
        raise error
    return status
