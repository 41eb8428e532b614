"""Sharding with size-tiered compaction and versioned manifests.

A store folder holds immutable Parquet files and manifests v00000001.json and
so on; a manifest lists the files of its version. An arrival is appended as it
comes, each file of it a run. Runs whose sizes fall into the same tier (sizes
up to a factor FAN_IN apart) are merged, once there are FAN_IN of them, into
files of about target_bytes, without a shuffle: one job reads up to BATCH_RUNS
runs, a task those of one file to be, and one commit puts its files in place of
them, so that neither a plan nor a repeat after a failure grows with the store.
Every change is a new manifest, put in place by a rename that fails if the
version exists; the loser re-reads the newest version and applies its change to
that, or drops a merge whose runs are gone.

A writer leaves an intent, which names its data folder, before it writes and
takes it away after its commit. vacuum() deletes only files that no retained
version lists, that no intent covers, and that are older than a grace time.

Defined results: rows are kept as they are, with nulls, repeats and all columns;
an arrival may bring columns that the store doesn't have (null in all other
rows) and lack others, in any order; one whose column has another type than the
store's is refused before anything is written; an empty arrival adds a version
without runs; readers of an older version find its files until vacuum() drops it.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from . import runtime

FAN_IN = 4
TARGET_BYTES = 128 << 20
SMALLEST = 1 << 16
#: Runs that a merge job reads at most.
BATCH_RUNS = 4096
#: Seconds for which vacuum() leaves files and versions alone.
GRACE = 24 * 3600


class TieredStore:
    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.folder, self.target, self.fan_in = spark, folder.rstrip("/"), target_bytes, fan_in

    def _status(self, path: str) -> list[tuple[str, int, float]]:
        """(path, bytes, seconds since 1970 of the last change) of what is in a folder."""
        fs, at = runtime._hadoop(self.spark, path)
        return [(f.getPath().toString(), f.getLen(), f.getModificationTime() / 1000) for f in fs.listStatus(at)] if fs.exists(at) else []

    def _files(self, path: str) -> list[tuple[str, int]]:
        return [(p, n) for p, n, _ in self._status(path)]

    def version(self) -> int:
        """The newest version; 0 before the first."""
        names = [p.rsplit("/", 1)[1] for p, _ in self._files(f"{self.folder}/manifests")]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "runs": []}
        fs, at = runtime._hadoop(self.spark, f"{self.folder}/manifests/v{version:08d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, change) -> dict:
        """Applies change (manifest to manifest, or None: nothing to do) to the newest version, as often as another writer is faster."""
        jvm = self.spark._jvm
        while True:
            old = self.manifest()
            new = change(old)
            if new is None:
                return old
            new = new | {"version": old["version"] + 1}
            fs, draft = runtime._hadoop(self.spark, f"{self.folder}/manifests/draft-{uuid.uuid4().hex}")
            out = fs.create(draft, False)
            out.write(json.dumps(new).encode())
            out.close()
            final = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/v{new['version']:08d}.json")
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            try:
                files.rename(draft, final, options)
                return new
            except Exception as e:  # noqa: BLE001  py4j wraps what Java throws
                fs.delete(draft, False)
                if "FileAlreadyExists" not in str(e):
                    raise

    @contextmanager
    def _writing(self, df: DataFrame) -> Iterator[list[dict]]:
        """Writes df to a data folder of its own, which an intent covers until the block's end; the files written."""
        name = uuid.uuid4().hex
        fs, intent = runtime._hadoop(self.spark, f"{self.folder}/intents/{name}")
        fs.create(intent, False).close()
        try:
            path = f"{self.folder}/data/{name}"
            df.write.option("compression", "zstd").parquet(path)
            yield [{"path": p, "bytes": n} for p, n in self._files(path) if p.endswith(".parquet")]
        finally:
            fs.delete(intent, False)

    @staticmethod
    def _merged_schema(old: str | None, new: StructType) -> str:
        """old with the columns that only new has; null columns are allowed in all of them."""
        fields = list(StructType.fromJson(json.loads(old)).fields) if old else []
        have = {f.name: f.dataType for f in fields}
        low = {n.lower(): n for n in have}
        for f in new.fields:
            if f.name in have and have[f.name] != f.dataType:
                raise ValueError(f"column {f.name} is {have[f.name].simpleString()} in the store and {f.dataType.simpleString()} in the arrival")
            if f.name not in have and f.name.lower() in low:
                raise ValueError(f"column {f.name} differs from the store's {low[f.name.lower()]} in case alone")
        return StructType([StructField(f.name, f.dataType, True) for f in [*fields, *(f for f in new.fields if f.name not in have)]]).json()

    def append(self, arrival: DataFrame) -> dict:
        """Adds the arrival's rows as small shards, one for each of its partitions."""
        self._merged_schema(self.manifest()["schema"], arrival.schema)  # refused before anything is written
        with self._writing(arrival) as runs:
            return self._commit(lambda m: {"schema": self._merged_schema(m["schema"], arrival.schema), "runs": m["runs"] + runs})

    def _tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, SMALLEST) / SMALLEST, self.fan_in)))

    def _full_tier(self, runs: list[dict]) -> list[dict]:
        """The runs to merge next: of the lowest tier with FAN_IN runs that aren't of target size yet."""
        tiers: dict[int, list[dict]] = {}
        for r in sorted(runs, key=lambda r: (r["bytes"], r["path"])):
            if r["bytes"] * 2 <= self.target:
                tiers.setdefault(self._tier(r["bytes"]), []).append(r)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), [])

    def compact(self) -> dict:
        """Merges until no tier has FAN_IN runs that merging makes fewer; returns the newest manifest."""
        while True:
            m = self.manifest()
            chosen = self._full_tier(m["runs"])[:BATCH_RUNS]
            files = math.ceil(sum(r["bytes"] for r in chosen) / self.target)
            if files >= len(chosen):
                return m
            # one scan of all runs; its partitions, each of some whole runs, are strung together for each file
            with self._writing(self._read(m["schema"], [r["path"] for r in chosen]).coalesce(files)) as new:
                gone = {r["path"] for r in chosen}
                self._commit(lambda now: {"schema": now["schema"], "runs": [r for r in now["runs"] if r["path"] not in gone] + new} if gone <= {r["path"] for r in now["runs"]} else None)

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema)) if schema else StructType([])
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._read(m["schema"], [r["path"] for r in m["runs"]])

    def vacuum(self, grace: float = GRACE) -> int:
        """Drops versions that were replaced over `grace` seconds ago, and files that then no version
        lists, no intent covers and that are older than that too; returns the number of files."""
        before = time.time() - grace
        newest = self.version()
        stamps = sorted((int(p.rsplit("/", 1)[1][1:-5]), p, t) for p, _, t in self._status(f"{self.folder}/manifests") if p.endswith(".json"))
        # a version ends when the next one is put in place
        old = [(v, p) for (v, p, _), (_, _, ended) in zip(stamps, stamps[1:]) if v < newest and ended < before]
        for _, p in old:
            runtime.delete_folder(self.spark, p)
        # intents are read before the manifests: a writer that commits in between is in one or the other
        covered = {p.rsplit("/", 1)[1] for p, _ in self._files(f"{self.folder}/intents")}
        dropped = {v for v, _ in old}
        keep = {r["path"] for v, _, _ in stamps if v not in dropped for r in self.manifest(v)["runs"]} | {r["path"] for r in self.manifest()["runs"]}
        gone = [p for folder, _ in self._files(f"{self.folder}/data") if folder.rsplit("/", 1)[1] not in covered for p, _, t in self._status(folder) if p.endswith(".parquet") and p not in keep and t < before]
        for p in gone:
            runtime.delete_folder(self.spark, p)
        return len(gone)


def shard(docs: DataFrame, folder: str, target_bytes: int = TARGET_BYTES) -> TieredStore:
    """Appends docs to the store in folder, compacts it and drops what has not counted for GRACE seconds."""
    store = TieredStore(docs.sparkSession, folder, target_bytes)
    store.append(docs)
    store.compact()
    store.vacuum()
    return store
