"""Bounded-space online packing of token streams into sequences of at most `capacity` tokens.

Each partition keeps `open_windows` windows. A document's full windows leave at
once; what is left of it goes to the open window that it fills best. When it
fits in none, the fullest window is topped up with a cut of it and emitted, or
emitted as it is if it is full. What is open at a partition's end is merged:
the windows of FAN_IN bundles (first: partitions) are put together, the largest
first, each into the window that it fills best, without cuts; the fullest are
final, and only `open_windows` of them stay open for the next level. So a merge
reads at most FAN_IN x open_windows windows, whatever the number of partitions,
and takes a constant number of steps for each of them.

Defined results: null text is an empty document, which is its end id alone; a
null doc_id and repeated rows are documents like any other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .tokens import encoder

CAPACITY = 2048
OPEN_WINDOWS = 32
FAN_IN = 64
_BATCH = 256


class _Packer:
    """Windows of (document, start, ids) pieces; emitted ones get a number."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.open: list[tuple[int, list]] = []  # (free, pieces)
        self.out: list[list] = []

    def add(self, doc, ids: np.ndarray) -> None:
        start, n, cap = 0, len(ids), self.capacity
        while n - start >= cap:
            self.out.append([(doc, start, ids[start : start + cap])])
            start += cap
        while start < n:
            size = n - start
            fit = min((w for w in self.open if w[0] >= size), key=lambda w: w[0], default=None)
            if fit is None and len(self.open) < self.windows:
                fit = (cap, [])
                self.open.append(fit)
            if fit is None:  # cut: the fullest window takes what it can and leaves
                fit = min(self.open, key=lambda w: w[0])
                size = fit[0]
            self.open.remove(fit)
            fit[1].append((doc, start, ids[start : start + size]))
            start += size
            if fit[0] == size:
                self.out.append(fit[1])
            else:
                self.open.append((fit[0] - size, fit[1]))


_PIECE = "start long, length long, ids binary, doc_tokens long, bundle int, window long, offset long, filled int"


def _rows(doc_type: pa.DataType, bundle: int, windows: list[tuple[int, list, bool]]) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(9)]
    for number, pieces, is_open in windows:
        offset, filled = 0, sum(len(p[2]) for p in pieces)
        for (doc, total), start, ids in pieces:
            for c, v in zip(cols, (doc, start, len(ids), ids.tobytes(), total, bundle, number, offset, filled if is_open else 0)):
                c.append(v)
            offset += len(ids)
    types = [doc_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "start", "length", "ids", "doc_tokens", "bundle", "window", "offset", "filled"])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """The pieces of all texts: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    tokenizer: path of a file of the tokenizers library; end_id ends each document.
    """
    spark = docs.sparkSession
    folder = runtime.work_folder(spark, "packing")
    df = runtime.only(docs)
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, packer, number, doc_type = encoder(tokenizer), _Packer(capacity, open_windows), 0, None
        for b in batches:
            doc_type = b.column(0).type
            for k in range(0, b.num_rows, _BATCH):
                names = b.column(0).slice(k, _BATCH).to_pylist()
                for name, ids in zip(names, encode([t or "" for t in b.column(1).slice(k, _BATCH).to_pylist()], end_id)):
                    packer.add((name, len(ids)), ids)
                if packer.out:
                    yield _rows(doc_type, part, [(number + i, p, False) for i, p in enumerate(packer.out)])
                    number += len(packer.out)
                    packer.out = []
        if packer.open:
            yield _rows(doc_type, part, [(number + i, p, True) for i, (_, p) in enumerate(packer.open)])

    pieces = runtime.written(df.mapInArrow(run, f"doc_id {id_type}, {_PIECE}"), folder, "pieces")
    left = pieces.where("filled > 0").groupBy("bundle", "window").agg(F.max("filled").alias("filled"))
    # own, window: an open window; head, head_window: the window that it is part of by now, from `at` on; group: its bundle, -1 once it is final
    left = runtime.written(left.select(F.col("bundle").cast("long").alias("own"), "window", "filled", F.col("bundle").cast("long").alias("head"), F.col("window").alias("head_window"), F.lit(0).cast("long").alias("at"), F.col("bundle").cast("long").alias("group")), folder, "left0")
    level, groups = 0, left.agg(F.coalesce(F.max("group"), F.lit(0))).first()[0] + 1
    while groups > 1 or level == 0:
        groups, level = (groups + FAN_IN - 1) // FAN_IN, level + 1
        # a row a window that is still open: its size is that of all windows in it
        heads = left.where("group >= 0").groupBy("head", "head_window", (F.floor(F.col("group") / FAN_IN).cast("long")).alias("group")).agg(F.sum("filled").cast("int").alias("filled"))
        merged = heads.groupBy("group").applyInPandas(_merger(capacity, open_windows), _MOVE)
        merged = runtime.written(merged, folder, f"moves{level}")
        now = left.join(runtime.if_small(merged), ["head", "head_window"], "left")
        left = runtime.written(now.select("own", "window", "filled", F.coalesce("to", "head").alias("head"), F.coalesce("to_window", "head_window").alias("head_window"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"), F.coalesce("next", F.lit(-1)).cast("long").alias("group")), folder, f"left{level}")
    moved = left.select(F.col("own").cast("int").alias("bundle"), "window", F.col("head").alias("to"), F.col("head_window").alias("to_window"), "at")
    # one pass over the pieces: only open windows have another place than their own
    parts = pieces.join(runtime.if_small(moved), ["bundle", "window"], "left").withColumns({"to": F.coalesce("to", F.col("bundle").cast("long")), "to_window": F.coalesce("to_window", "window"), "at": F.coalesce("at", F.lit(0).cast("long"))})
    sequence = F.shiftleft(F.col("to"), 40) + F.col("to_window")
    return parts.select("doc_id", "start", "length", "ids", "doc_tokens", sequence.alias("sequence_id"), (F.col("offset") + F.col("at")).alias("offset"))


_MOVE = "head long, head_window long, to long, to_window long, more long, next long"


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(number of the bin, place in it) of each size, in the order given: into the fullest bin that takes it, else a new one.

    Bins are stacked by their free space and a bit for each free space says
    whether there is one: a step costs the same for any number of bins.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins, out = 0, 0, []
    for size in sizes:
        fits = some >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                some ^= 1 << free
        else:
            free, b = capacity, bins
            bins += 1
        out.append((b, capacity - free))
        free -= size
        if free:
            stacks[free].append(b)
            some |= 1 << free
    return out


def _merger(capacity: int, open_windows: int):
    """Puts the windows of a bundle together; `next` is the bundle for those that stay open, -1 for others."""

    def merge(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["filled", "head", "head_window"], ascending=[False, True, True])
        placed = best_fit(pdf["filled"].tolist(), capacity)
        b, at = np.array([x for x, _ in placed]), np.array([x for _, x in placed])
        first = np.unique(b, return_index=True)[1]
        total = np.bincount(b, pdf["filled"])
        # the emptiest bins stay open
        stay = np.zeros(len(total), bool)
        stay[np.argsort(total, kind="stable")[:open_windows]] = True
        stay &= total < capacity
        head, window = pdf["head"].to_numpy(), pdf["head_window"].to_numpy()
        return pd.DataFrame({"head": head, "head_window": window, "to": head[first][b], "to_window": window[first][b], "more": at, "next": np.where(stay[b], pdf["group"].to_numpy(), -1)})

    return merge
