"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprints: each text's word shingles are hashed (XXH64, seed 42) and
   summed up in its task; a row of 8 bytes leaves it.
2. Copies collapse: only distinct fingerprints are searched, each a node of that
   name. A group of exact copies costs one row.
3. Bits that are correlated go to one partition: a 64 x 64 co-occurrence
   matrix, summed over all fingerprints, orders them.
4. Thresholds: if partition i is given t_i >= -1 and sum(t_i) = tau - m + 1, a
   pair within tau bits is within t_i bits in some partition i (-1: not probed).
   Dynamic programming picks m and the t_i with the fewest estimated candidates
   plus probe rows; the estimate uses exact histograms of eight 8-bit blocks of
   all fingerprints, and so its size does not depend on the input.
5. Probe and verify: fingerprints meet in cells (partition, value), which
   are compared in blocks in NumPy; a cell emits at most one edge for each of
   its rows, never its pairs. Cells over CELL_ROWS are cut into blocks of
   rows and every pair of blocks is compared in a task of its own.
6. Components: alternating large-star and small-star rounds on written edges;
   the smallest doc_id of each is looked up afterwards, so that fingerprints
   which only rows without doc_id have connect others like any other.

Defined results: null and empty texts, and texts without words, have fingerprint
0 and link like any other; texts of fewer words than a shingle are hashed whole;
null doc_id: the row keeps its fingerprint, is never a representative, and its
component is that of its links (null if it has none with an id); rows that
repeat a doc_id share a component if their texts do; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

BITS, BLOCKS = 64, 8
SEED = 42
#: Rows of a cell that one comparison takes at once; larger cells are cut into blocks.
CELL_ROWS = 2048
#: Cells that are cut, up to which their list is broadcast; beyond, it is joined in SALTS parts, so that no cell's rows are in one task.
CUT_CELLS, SALTS = 1_000_000, 32
#: Estimated cost of a probe row in candidate comparisons.
PROBE_COST = 200.0
FEWEST, MOST = 2, 6

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GAPS = bytes([9, 10, 11, 12, 13])
_TO_SPACE = bytes(32 if b in _GAPS else b for b in range(256))


def _fold(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and the six kinds of ASCII white space as spaces."""
    return text.encode("utf-8", "replace").translate(_LOWER).translate(_TO_SPACE)


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """The hash of each of a text's word shingles; none if it has no words."""
    from xxhash import xxh64_intdigest as digest

    words = _fold(text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    # white space runs collapse to one space, so a shingle is a slice of one string
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half the shingles' hashes."""
    return int(_majority(shingles(text, width)))


def _majority(hashes: np.ndarray) -> np.uint64:
    """Counts each bit in blocks, so that long texts need no 64-fold memory."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (long: the fingerprint's 64 bits) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    df = runtime.only(docs)
    id_type = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {id_type}, fp long")


def unpacked(fps: np.ndarray) -> np.ndarray:
    """Rows x 64 bits, the lowest first."""
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def summed_rows(df: DataFrame, of, size: int) -> np.ndarray:
    """The sum over all of df of a fixed number of counts that `of` makes of the first column of a batch."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            total += of(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["k", "v"])

    rows = df.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for k, v in rows:
        out[k] = v
    return out


def _fps(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def grown_order(together: np.ndarray, n: float) -> list[int]:
    """The 64 bits, correlated ones next to each other: groups of eight grown greedily from the most correlated pair left.

    together: how many of n fingerprints have bits i and j both set.
    """
    co = together / max(1.0, n)
    p = np.diag(co)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(co - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, order = list(range(BITS)), []
    while left:
        sub = corr[np.ix_(left, left)]
        group = [left[int(np.argmax(sub.sum(axis=1)))]]
        rest = [b for b in left if b != group[0]]
        while len(group) < BITS // BLOCKS:
            group.append(best := max(rest, key=lambda b: (corr[b, group].sum(), -b)))
            rest.remove(best)
        order += group
        left = rest
    return order


def bit_order(fps: DataFrame) -> list[int]:
    """grown_order of all fingerprints."""
    both = summed_rows(fps.select("fp"), lambda c: (lambda b: np.concatenate((b.T @ b, [[len(c)] + [0] * (BITS - 1)])).ravel())(unpacked(_fps(c)).astype(np.float32)), BITS * (BITS + 1))
    return grown_order(both[: BITS * BITS].reshape(BITS, BITS), both[BITS * BITS])


def block_chances(shares: np.ndarray, most: int) -> list[list[float]]:
    """For each block's shares of its 256 values: the chances that two fingerprints differ in 0..most of its bits."""
    distance = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
    return [[np.outer(h, h)[distance == d].sum() for d in range(most + 1)] for h in shares]


def permuted(fps: np.ndarray, order: list[int]) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(unpacked(fps)[:, order], axis=1, bitorder="little")).view(np.uint64).ravel()


def plan(fps: DataFrame, order: list[int], tau: int = 3) -> list[tuple[int, int, int]]:
    """(first bit, number of bits, threshold) of the partitions that are probed."""
    histogram = summed_rows(fps.select("fp"), lambda x: np.concatenate([np.bincount(c, minlength=256) for c in permuted(_fps(x), order).view(np.uint8).reshape(-1, 8).T]).astype(float), BLOCKS * 256).reshape(BLOCKS, 256)
    n = max(1.0, histogram[0].sum())
    block = block_chances(histogram / n, tau)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(FEWEST, MOST + 1):
        edges = [round(k * BLOCKS / m) for k in range(m + 1)]
        parts = []
        for a, b in zip(edges, edges[1:]):
            chance = np.array([1.0])
            for x in block[a:b]:
                chance = np.convolve(chance, x)[: tau + 1]
            chance = np.cumsum(np.pad(chance, (0, tau + 1 - len(chance))))
            width, probes, costs = (b - a) * 8, 0, {-1: 0.0}
            for t in range(tau + 1):
                probes += _choose(width, t)
                costs[t] = n * n / 2 * chance[t] + PROBE_COST * n * (probes + (t > 0))
            parts.append((a * 8, width, costs))
        table: dict[int, tuple[float, list]] = {0: (0.0, [])}  # sum of (t_i + 1) so far: cost, partitions
        for first, width, costs in parts:
            step: dict[int, tuple[float, list]] = {}
            for spent, (cost, chosen) in table.items():
                for t, c in costs.items():
                    if spent + t + 1 <= tau + 1 and cost + c < step.get(spent + t + 1, (float("inf"),))[0]:
                        step[spent + t + 1] = (cost + c, [*chosen, (first, width, t)])
            table = step
        if table[tau + 1][0] < best[0]:
            best = table[tau + 1]
    return [x for x in best[1] if x[2] >= 0]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _flips(width: int, t: int) -> np.ndarray:
    """All masks of 1 to t of the lowest `width` bits."""
    masks, last = [], [(0, -1)]
    for _ in range(t):
        last = [(m | 1 << b, b) for m, top in last for b in range(top + 1, width)]
        masks += [m for m, _ in last]
    return np.array(masks, np.uint64)


def _cells(nodes: DataFrame, order: list[int], parts: list[tuple[int, int, int]]) -> DataFrame:
    """part, value, role (0: is there; 1: probes from nearby), node, fp of every fingerprint in every cell that it is in or probes."""

    def run(batches):
        for b in batches:
            node, fps = b.column(0), b.column(1)
            bits = permuted(fps.to_numpy(zero_copy_only=False).view(np.uint64), order)
            for k, (first, width, t) in enumerate(parts):
                own = bits >> np.uint64(first) & np.uint64((1 << width) - 1)
                for mask in np.concatenate((np.zeros(1, np.uint64), _flips(width, t))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array((own ^ mask).view(np.int64)), pa.array(np.full(len(own), int(mask != 0), np.int32)), node, fps], ["part", "value", "role", "node", "fp"])

    id_type = nodes.schema["node"].dataType.simpleString()
    return nodes.select("node", "fp").mapInArrow(run, f"part int, value long, role int, node {id_type}, fp long")


def connected(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (of each row the number of one of its component's rows, the smallest's that of itself), with rows a and b joined."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not (label[label] == label).all():
            label = label[label]


def _linked(group: np.ndarray, fps: np.ndarray, role: np.ndarray, side: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) that connect what is linked within each group; rows are in the order of group.

    Of a pair at least one row must be there (role 0); side: in a group of two
    blocks, 0 or 1, only rows of different sides are compared; -1: all are.
    """
    n = len(group)
    label = np.arange(n)
    sizes = np.diff(np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), n)) if n else np.zeros(0, int)
    for k in range(1, int(sizes.max(initial=1))):
        i = np.flatnonzero(group[k:] == group[:-k])
        j = i + k
        ok = (np.bitwise_count(fps[i] ^ fps[j]) <= tau) & ((role[i] == 0) | (role[j] == 0)) & ((side[i] != side[j]) | (side[i] < 0))
        label = connected(label, i[ok], j[ok])
    tied = np.flatnonzero(label != np.arange(n))
    return tied, label[tied]


def _with_blocks(cells: DataFrame, large: DataFrame) -> DataFrame:
    """cells with the number of blocks of those that large lists."""
    if large.count() <= CUT_CELLS:
        return cells.join(F.broadcast(large), ["part", "value"], "left")
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cells.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted, ["part", "value", "salt"], "left").drop("salt")


def edges(nodes: DataFrame, tau: int = 3, folder: str | None = None) -> DataFrame:
    """a, b: links of distinct fingerprints, enough to connect all that are within tau bits. nodes: node, fp, both unique."""
    order = bit_order(nodes)
    parts = plan(nodes, order, tau)
    cells = _cells(nodes, order, parts)
    if folder:
        cells = runtime.written(cells, folder, "cells")
    # a cell of over CELL_ROWS rows becomes blocks of about half as many; each pair of blocks meets in a cell of its own
    large = cells.groupBy("part", "value").count().where(F.col("count") > CELL_ROWS).select("part", "value", F.ceil(F.col("count") / (CELL_ROWS // 2)).cast("int").alias("blocks"))
    large = runtime.written(large, folder, "large") if folder else large
    dealt = _with_blocks(cells, large).withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select("part", "value", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"), "role", "node", "fp")
    keys = ["part", "value", "low", "high"]

    def run(batches):
        rest: pa.Table | None = None

        def done(t: pa.Table) -> pa.RecordBatch:
            new = np.zeros(t.num_rows, bool)
            for c in keys:
                v = t.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            get = lambda c: t.column(c).to_numpy()
            x, y = _linked(np.cumsum(new), get("fp").view(np.uint64), get("role"), get("side"), tau)
            node = t.column("node").combine_chunks()
            return pa.RecordBatch.from_arrays([node.take(pa.array(x)), node.take(pa.array(y))], ["a", "b"])

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            v = np.stack([t.column(c).to_numpy().astype(np.int64) for c in keys])
            last = np.flatnonzero((v != v[:, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield done(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield done(rest)

    id_type = nodes.schema["node"].dataType.simpleString()
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"a {id_type}, b {id_type}").distinct()


def components(edges_: DataFrame, folder: str) -> DataFrame:
    """node, component (its smallest node) of every node with an edge: large-star and small-star in turn until nothing changes."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    now = runtime.written(edges_.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, "edges0")
    step, before = 0, None
    while True:
        # large-star: a node's larger neighbours go to its smallest neighbour
        pairs = both(now)
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = pairs.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        step += 1
        after = runtime.written(small, folder, f"edges{step}")
        # the sum of hashes is compared: no edge reaches the driver
        mark = tuple(after.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())
        runtime.delete_folder(edges_.sparkSession, f"{folder}/edges{step - 1}")
        if mark == before:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(after.select("b", "b")).distinct()
        now, before = after, mark


def near_duplicates(docs: DataFrame, tau: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fp (long), component_id (smallest doc_id reachable by links of at most tau bits), a row for each row of docs."""
    folder = runtime.work_folder(docs.sparkSession, "simhash")
    fps = runtime.written(fingerprints(docs, width), folder, "fingerprints")
    nodes = runtime.written(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), folder, "nodes")
    found = runtime.written(components(edges(nodes.select(F.col("fp").alias("node"), "fp"), tau, folder), folder).withColumnRenamed("node", "fp"), folder, "found")
    least = runtime.written(found.join(nodes, "fp").groupBy("component").agg(F.min("doc_id").alias("component_id")), folder, "least")
    joined = found.join(runtime.if_small(least), "component").select("fp", "component_id", F.lit(True).alias("joined"))
    named = nodes.join(joined, "fp", "left").select("fp", F.when(F.col("joined"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    named = runtime.written(named, folder, "named")
    return runtime.settled(fps.join(named, "fp").select("doc_id", "fp", "component_id"), folder, "near-duplicates")


def keep_one(docs: DataFrame, tau: int = 3, width: int = 3) -> DataFrame:
    """The rows of docs of each group's smallest doc_id, and rows without doc_id; rows that repeat a doc_id stay or go together."""
    found = near_duplicates(docs, tau, width)
    gone = runtime.fresh("gone_id", docs)
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias(gone)).distinct()
    drop = runtime.written(drop.join(stay, gone, "left_anti"), runtime.work_folder(docs.sparkSession, "duplicates"), "rows")
    return docs.join(runtime.if_small(drop), docs["doc_id"] == drop[gone], "left_anti")
