"""Token ids in binary shards, each document a zstandard frame of its own.

A store folder holds shards and a manifest. A shard is: a header (magic, bytes
for each id, SHA-256 of the dictionary), the documents' frames one after the
other, an offset index (an Arrow stream: doc_id, offset, size, n_tokens), and a
footer with the index's place. All frames share one dictionary, trained on the
serialized ids of at most DICT_DOCS documents (chosen by a hash of doc_id; it
affects sizes only, never contents). A single document is read with two short
reads. Documents are in ascending doc_id order, within and across shards (rows
of equal doc_id: by a hash of their text; null doc_ids first). Tasks write
under names of their own and a shard counts once the manifest names it, so
repeated or lost tasks leave only files that nothing refers to.

Defined results: null and empty texts are the end id alone; an empty table
gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .tokens import encoder

MAGIC = b"TOKZST1\n"
HEADER, FOOTER = "<8sB32s", "<QQ8s"
DICT_DOCS, DICT_BYTES, LEVEL = 1000, 64 << 10, 3
_BATCH = 128


def _serial(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """Trained on about DICT_DOCS documents of up to 100,000 characters; empty if zstandard finds them too few."""
    import zstandard

    share = DICT_DOCS / max(1, docs.count())
    sample = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) & (F.length("text") <= 100_000))

    def run(batches):
        encode = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_serial(x, width) for x in encode([t or "" for t in b.column(1).to_pylist()], end_id)], pa.binary())], ["ids"])

    samples = [r[0] for r in sample.mapInArrow(run, "ids binary").limit(2 * DICT_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> dict:
    """Writes all texts' ids to shards in folder and commits the manifest, which it returns."""
    from tokenizers import Tokenizer

    docs = runtime.only(docs)
    width = 2 if max(end_id + 1, Tokenizer.from_file(tokenizer).get_vocab_size()) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    digest = hashlib.sha256(dictionary).digest()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, path = TaskContext.get().partitionId(), f"{folder}/shard-{uuid.uuid4().hex}.tok"
        encode, squeeze = encoder(tokenizer), _compressor(dictionary)
        out, at, index, total, n_docs = None, struct.calcsize(HEADER), [], 0, 0
        for b in batches:
            for k in range(0, b.num_rows, _BATCH):
                if out is None:
                    fs, where = runtime.open_fs(path)
                    out = fs.open_output_stream(where)
                    out.write(struct.pack(HEADER, MAGIC, width, digest))
                frames, sizes = [], []
                for ids in encode([t or "" for t in b.column(1).slice(k, _BATCH).to_pylist()], end_id):
                    frames.append(squeeze.compress(_serial(ids, width)))
                    sizes.append(len(ids))
                out.write(b"".join(frames))
                lengths = np.array([len(f) for f in frames], np.int64)
                index.append(pa.RecordBatch.from_arrays([b.column(0).slice(k, _BATCH), pa.array(at + np.cumsum(lengths) - lengths), pa.array(lengths), pa.array(sizes, pa.int64())], ["doc_id", "offset", "size", "n_tokens"]))
                at, total, n_docs = at + int(lengths.sum()), total + sum(sizes), n_docs + len(sizes)
        if out is not None:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, index[0].schema) as stream:
                for b in index:
                    stream.write_batch(b)
            table = sink.getvalue()
            out.write(table)
            out.write(struct.pack(FOOTER, at, table.size, MAGIC))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([total], pa.int64()), pa.array([at + table.size + struct.calcsize(FOOTER)], pa.int64())], ["part", "path", "n_docs", "n_tokens", "bytes"])

    order = ["doc_id", F.xxhash64("text")]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = runtime.written(dealt.mapInArrow(run, "part int, path string, n_docs long, n_tokens long, bytes long"), folder, "shards")
    rows = [r.asDict() for r in shards.orderBy("part").collect()]  # one row for each file
    start = 0
    for r in rows:
        r["start"], start = start, start + r["n_tokens"]
    manifest = {"dictionary": dictionary.hex(), "dictionary_sha256": digest.hex(), "width": width, "end_id": end_id, "doc_id": id_type, "tokens": start, "shards": rows}
    fs, where = runtime.open_fs(folder)
    with fs.open_output_stream(f"{where}/manifest.json.part") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{where}/manifest.json.part", f"{where}/manifest.json")
    return manifest


def load_manifest(folder: str) -> dict:
    fs, where = runtime.open_fs(folder)
    with fs.open_input_stream(f"{where}/manifest.json") as f:
        return json.loads(f.read())


def _index(file, dictionary: bytes) -> tuple[int, pa.Table]:
    """(bytes for each id, offset index) of an open shard, its header and footer checked."""
    magic, width, digest = struct.unpack(HEADER, file.read_at(struct.calcsize(HEADER), 0))
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a shard of this dictionary")
    at, size, magic = struct.unpack(FOOTER, file.read_at(struct.calcsize(FOOTER), file.size() - struct.calcsize(FOOTER)))
    if magic != MAGIC:
        raise ValueError("the shard's end is missing")
    return width, pa.ipc.open_stream(file.read_at(size, at)).read_all()


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) of every document."""
    m = load_manifest(folder)
    dictionary = bytes.fromhex(m["dictionary"])

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, where = runtime.open_fs(path)
                with fs.open_input_file(where) as file:
                    width, index = _index(file, dictionary)
                    expand, kind = _decompressor(dictionary), "<u2" if width == 2 else "<u4"
                    for part in index.to_batches(max_chunksize=_BATCH):
                        offsets, sizes, n = (part.column(c).to_numpy() for c in ("offset", "size", "n_tokens"))
                        block = file.read_at(int(offsets[-1] + sizes[-1] - offsets[0]), int(offsets[0]))
                        ids = [np.frombuffer(expand.decompress(block[o : o + s]), kind).astype("<u4").tobytes() for o, s in zip((offsets - offsets[0]).tolist(), sizes.tolist())]
                        starts = start + np.cumsum(n) - n
                        start += int(n.sum())
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    rows = [(s["path"], s["start"]) for s in m["shards"]]
    files = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return files.mapInArrow(run, f"doc_id {m['doc_id']}, start long, n_tokens long, ids binary")


def read_document(folder: str, shard: int, k: int, manifest: dict | None = None) -> np.ndarray:
    """The ids of the k-th document of a shard, by its offset index: nothing else is decompressed."""
    m = manifest or load_manifest(folder)
    dictionary = bytes.fromhex(m["dictionary"])
    fs, where = runtime.open_fs(m["shards"][shard]["path"])
    with fs.open_input_file(where) as file:
        width, index = _index(file, dictionary)
        frame = file.read_at(index.column("size")[k].as_py(), index.column("offset")[k].as_py())
    return np.frombuffer(_decompressor(dictionary).decompress(frame), "<u2" if width == 2 else "<u4").astype(np.uint32)
