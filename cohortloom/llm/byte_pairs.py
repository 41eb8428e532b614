"""Byte-level BPE over overlapping chunks; decoding concatenates raw bytes.

Texts of up to CHUNK + OVERLAP characters are encoded where they are. A longer
one is cut into chunks of CHUNK characters that each look OVERLAP further:

1. Every chunk is pre-tokenised by a task of its own, from its first character,
   which may be in the middle of a pre-token.
2. Two neighbours have resynchronised at the first boundary in their overlap
   that both have, behind a character that isn't white space and where the class
   of characters changes so that no pre-token spans it. What is before it goes
   to the left chunk, what follows to the right one. No pattern looks back, and
   the only one that looks ahead matches white space, so either side can be
   matched without the other.
3. Neighbours without such a boundary (one run of letters or white space, say,
   all along the overlap) become one chunk, which is pre-tokenised again. Each
   round leaves fewer chunks; the last has one that covers the pre-token.
4. The pieces between the boundaries are encoded in parallel and each text's ids
   are strung together. Only short lists of boundaries are compared across
   chunks; no text goes through one task in whole until its ids, which are one
   row of the result, are joined.

Boundaries count only where Unicode classes don't depend on the library's
version: characters of no known class are skipped.

Defined results: null and empty texts have no ids and no bytes; ids decode to
the text's UTF-8; ids that the ranks don't have fail; rows that repeat and rows
without doc_id give a row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

CHUNK, OVERLAP = 65_536, 1_024
#: Rows that are encoded or decoded before they are handed on.
_ROWS = 256


class Codec:
    """Ids of text and bytes of ids by a file of ranks; `pattern` splits text before merges."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        sizes = np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        self.sizes = sizes
        self.starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        self.bytes = np.frombuffer(b"".join(token for token, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False) if text else np.zeros(0, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        sizes = self.sizes[ids]  # an id beyond the last rank is an IndexError
        if (sizes < 0).any():
            raise ValueError("an id that no rank has")
        total = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[ids] - total + sizes, sizes) + np.arange(total[-1])].tobytes()

    def boundaries(self, text: str) -> list[int]:
        """Where pre-tokens of the text end and stitching is safe, the text's own end left out."""
        return [e for e in (m.end() for m in self.pattern.finditer(text)) if e < len(text) and _parts(text[e - 1], text[e])]


def _class(c: str) -> str:
    kind = unicodedata.category(c)
    return "S" if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else kind[0] if kind[0] in "LN" else "" if kind == "Cn" else "P"


def _parts(before: str, after: str) -> bool:
    """Whether no pre-token, wherever matching began, has both characters: those that end in white space, and letters or digits before another class."""
    a, b = _class(before), _class(after)
    return bool(a and b) and a != "S" and (b == "S" or (a in "LN" and a != b))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec for the file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of overlapping chunks; each but the last has chunk + overlap characters."""
    return [(s, text[s : s + chunk + overlap]) for s in range(0, max(1, len(text) - overlap), chunk)]


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """key (of a row of long), doc_id, start, text of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, doc_id, text in zip(b.column(0), b.column(1), b.column(2)):
                rows = cut(text.as_py(), chunk, overlap)
                for k in range(0, len(rows), _ROWS):
                    part = rows[k : k + _ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(part), pa.int64()), pa.array([doc_id.as_py()] * len(part), b.column(1).type), pa.array([s for s, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())], ["key", "doc_id", "start", "text"])

    id_type = long.schema["doc_id"].dataType.simpleString()
    return long.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(run, f"key long, doc_id {id_type}, start long, text string")


def _marks(chunks: DataFrame, path: str, pattern: str, overlap: int) -> DataFrame:
    """key, start, head, tail: the boundaries in a chunk's first and last `overlap` characters, as places in the document."""

    def run(batches):
        code = codec(path, pattern)
        for b in batches:
            heads, tails = [], []
            for start, text in zip(b.column(1).to_pylist(), b.column(2)):
                t = text.as_py()
                at = code.boundaries(t)
                heads.append([start + e for e in at if e < overlap])
                tails.append([start + e for e in at if e >= len(t) - overlap])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["key", "start", "head", "tail"])

    return chunks.select("key", "start", "text").mapInArrow(run, "key long, start long, head array<long>, tail array<long>")


def _stitched(chunks: DataFrame, folder: str, path: str, pattern: str, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(chunks; key, start, entry, cut of each: where its piece begins, and ends or null at the text's end), merged until all neighbours have resynchronised."""
    line, step = Window.partitionBy("key").orderBy("start"), 0
    while True:
        marks = _marks(chunks, path, pattern, overlap)
        marks = marks.select("key", "start", F.array_min(F.array_intersect("tail", F.lead("head").over(line))).alias("cut"), F.lead("start").over(line).isNotNull().alias("more"))
        marks = runtime.written(marks, folder, f"marks{step}")
        if marks.where("more and cut is null").isEmpty():
            return chunks, marks.select("key", "start", F.coalesce(F.lag("cut").over(line), "start").alias("entry"), "cut")
        # a chunk begins a group where its left neighbour and it have met
        groups = marks.select("key", "start", F.sum(F.coalesce(F.lag("cut").over(line).isNotNull().cast("int"), F.lit(1))).over(line).alias("group"), (F.col("more") & F.col("cut").isNull()).alias("open"))
        own = F.when(F.col("open"), F.expr(f"substring(text, 1, length(text) - {overlap})")).otherwise(F.col("text"))
        merged = chunks.join(groups, ["key", "start"]).groupBy("key", "group").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("start", own.alias("text")))).alias("rows"))
        step += 1
        chunks = runtime.written(merged.select("key", "doc_id", "start", F.array_join("rows.text", "").alias("text")), folder, f"chunks{step}")


def _encoded(df: DataFrame, path: str, pattern: str, schema: str) -> DataFrame:
    """df with its last column, text, as ids (little-endian unsigned 32-bit integers)."""

    def run(batches):
        code = codec(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, _ROWS):
                part = b.slice(k, _ROWS)
                ids = pa.array([code.encode(t.as_py() or "").tobytes() for t in part.column(part.num_columns - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [*part.schema.names[:-1], "ids"])

    return df.mapInArrow(run, schema)


def _joined(table: pa.Table) -> pa.Table:
    """One row of the pieces of one text, whatever their order."""
    table = table.sort_by("start")
    ids = b"".join(x.as_py() for x in table.column("ids"))
    return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": pa.array([ids], pa.binary())})


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) of each row of docs."""
    docs = runtime.only(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk + overlap
    short = _encoded(docs.where(~is_long), path, pattern, f"doc_id {id_type}, ids binary")
    folder = runtime.work_folder(docs.sparkSession, "pieces")
    chunks = runtime.written(_chunks(docs.where(is_long), chunk, overlap), folder, "chunks0")
    chunks, places = _stitched(chunks, folder, path, pattern, overlap)
    places = runtime.written(places, folder, "places")
    piece = F.expr("substring(text, cast(entry - start + 1 as int), cast(coalesce(cut - entry, length(text)) as int))")
    pieces = chunks.join(runtime.if_small(places), ["key", "start"]).select("key", "doc_id", "start", piece.alias("text"))
    pieces = _encoded(pieces, path, pattern, f"key long, doc_id {id_type}, start long, ids binary")
    return short.unionByName(pieces.groupBy("key").applyInArrow(_joined, f"doc_id {id_type}, ids binary"))


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded (binary) of rows with doc_id and ids; null ids decode to nothing."""
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        code = codec(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, _ROWS):
                part = b.slice(k, _ROWS)
                out = pa.array([code.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), out], ["doc_id", "ids", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, ids binary, decoded binary")
