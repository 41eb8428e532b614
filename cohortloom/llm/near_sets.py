"""SimHash near-duplicates by similarity: pairs that share 0.8 of their five-word shingles, and no others.

Operator 7 (simhash_gph) with fingerprints long enough for that similarity. 64
bits can't tell 0.8 from chance: such a pair differs in 9.7 of them on average,
and all pairs within 14 bits are too many. Here:

1. Fingerprints: the set of a text's shingle hashes gives WORDS x 64 bits. Texts
   of equal sets are one node, named by the set's 128-bit digest.
2. Correlated bits of a word are put next to each other, in blocks of eight, and
   blocks in a row make partitions, as in simhash_gph.
3. Thresholds: a pair of the threshold's similarity agrees in a partition, within
   t bits, with a chance that only its width and t decide. Dynamic programming
   picks partitions of 16, 24 or 32 bits and t = 0, 1 or none for each, with
   the fewest estimated candidates (by exact block histograms of all nodes) and
   probes, so that the chance that no partition agrees is at most 1 - RECALL.
   More similar pairs are missed less: at 0.9 practically never.
4. Probe: nodes meet in cells (partition, value) and are compared by CHECK further
   words of bits and by their sets' sizes. A cell emits, for each of its rows, the
   nearest partner and at most one edge of a spanning forest of all partners, never
   its pairs. Cells over CELL_ROWS rows are cut into blocks, and every pair of
   blocks is compared in a task of its own.
5. Verify: shared shingles are counted on the whole sets; only a pair of at least
   THRESHOLD is a link. First each node and its nearest partner: n near copies cost
   about n verifications, and mostly become one component. What the spanning
   forests connect is a family; in families that are more than one component, the
   largest is verified against all other members and these against each other, in
   blocks, by products of incidence matrices, which emit links and no pairs.
6. Components as in simhash_gph.

Defined results: words are those of simhash_gph; texts of fewer words than a
shingle are one shingle; texts without words are equal to each other; rows
without doc_id are never compared and stay; rows that repeat a doc_id with
different texts are one document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .simhash_gph import BITS, BLOCKS, CELL_ROWS, PROBE_COST, block_chances, components, connected, grown_order, permuted, shingles, summed_rows, unpacked

WIDTH = 5
#: Smallest similarity (shared by all distinct shingles of two texts), in percent.
THRESHOLD = 80
#: Fingerprint words that partitions are taken from, words that candidates are checked by, and the chance that a pair at THRESHOLD meets.
WORDS, CHECK, RECALL = 16, 4, 0.99
#: The chance that the check words part a pair at THRESHOLD.
CHECK_MISS = 1e-4
#: Verified pairs of one first set that a task takes; more are dealt to several.
PAIRS = 256
#: Texts whose sets a Python worker holds at once.
SLICE = 256
#: Sets and hashes in them that a block of a family has, about; hashes in a row; columns of an incidence matrix.
BLOCK_SETS, BLOCK_HASHES, PIECE, COLUMNS = 256, 500_000, 1024, 4096
_UNIT = 0.01

_turn = np.random.default_rng(20260801)
_TIMES = _turn.integers(0, 1 << 63, (2, WORDS + CHECK), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingles(text, WIDTH))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS + CHECK words; a bit is 1 if it is set in over half the hashes, mixed anew for each word."""
    total = np.zeros((8, WORDS + CHECK, 8), np.int64)
    for k in range(0, len(hashes), 255):  # a byte counts up to 255
        x = hashes[k : k + 255, None] * _TIMES[0]
        x ^= x >> np.uint64(32)
        x *= _TIMES[1]
        x ^= x >> np.uint64(29)
        for lane in range(8):
            total[lane] += (x >> np.uint64(lane) & _LANES).sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    bits = (2 * total > len(hashes)).transpose(1, 2, 0).reshape(WORDS + CHECK, BITS)  # word, byte, lane
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def differing(similarity: float) -> float:
    """The chance that a bit differs in two sets of that similarity and, which is the worst case, equal size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _within(bits: int, p: float, most: int) -> float:
    return sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(most + 1))


def check_bits() -> int:
    """Check bits that a candidate may differ in."""
    p = differing(THRESHOLD / 100)
    return next(c for c in range(CHECK * BITS + 1) if _within(CHECK * BITS, p, c) >= 1 - CHECK_MISS)


def _small(batches):
    """The batches in slices: whole batches of sets would be many times the texts' memory."""
    for b in batches:
        for k in range(0, b.num_rows, SLICE):
            yield b.slice(k, SLICE)


def _digest(hashes: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes())


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node (the set's digest), n (its size) and fp (the fingerprint's words) of each row."""

    def run(batches):
        for b in _small(batches):
            sets = [shingle_set(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([wide_fingerprint(s).tobytes() for s in sets], pa.binary())], ["doc_id", "node", "n", "fp"])

    df = runtime.only(docs).where("doc_id is not null")
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, node binary, n int, fp binary")


def _words(column) -> np.ndarray:
    """Rows x words of a column of fingerprints."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS + CHECK)


def bit_orders(nodes: DataFrame) -> list[list[int]]:
    """The order of each word's bits, correlated ones next to each other."""

    def of(column):
        bits = [unpacked(np.ascontiguousarray(w)).astype(np.float32) for w in _words(column)[:, :WORDS].T]
        return np.concatenate([[len(column)], *[(b.T @ b).ravel() for b in bits]])

    both = summed_rows(nodes.select("fp"), of, 1 + WORDS * BITS * BITS)
    return [grown_order(c, both[0]) for c in both[1:].reshape(WORDS, BITS, BITS)]


def plan(nodes: DataFrame, orders: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(word, first bit, number of bits, threshold) of the partitions that are probed."""

    def of(column):
        words = [permuted(np.ascontiguousarray(w), o).view(np.uint8).reshape(-1, BLOCKS) for w, o in zip(_words(column).T, orders)]
        return np.concatenate([np.bincount(c, minlength=256) for w in words for c in w.T]).astype(float)

    histogram = summed_rows(nodes.select("fp"), of, WORDS * BLOCKS * 256).reshape(WORDS, BLOCKS, 256)
    n = max(1.0, histogram[0, 0].sum())
    p, wanted = differing(THRESHOLD / 100), math.ceil(-math.log(1 - RECALL) / _UNIT)
    gains = {(w, t): int(-math.log1p(-_within(w, p, t)) / _UNIT) for w in (16, 24, 32) for t in (0, 1)}
    # the cheapest way to each gain, one block after the other
    ways: list[dict[int, tuple[float, tuple]]] = [{} for _ in range(WORDS * BLOCKS + 1)]
    ways[0][0] = (0.0, ())
    for word in range(WORDS):
        chances = block_chances(histogram[word] / n, 1)
        for block in range(BLOCKS):
            at = word * BLOCKS + block
            options = [(1, 0, 0.0, None)]
            for size in (2, 3, 4):
                if block + size <= BLOCKS:
                    chance = np.array([1.0])
                    for x in chances[block : block + size]:
                        chance = np.convolve(chance, x)[:2]
                    for t in (0, 1):
                        cost = n * n / 2 * chance[: t + 1].sum() + PROBE_COST * n * (1 + t * (8 * size + 1))
                        options.append((size, gains[8 * size, t], cost, (word, 8 * block, 8 * size, t)))
            for gain, (cost, chosen) in ways[at].items():
                for size, more, extra, part in options:
                    to = min(wanted, gain + more)
                    if cost + extra < ways[at + size].get(to, (math.inf,))[0]:
                        ways[at + size][to] = (cost + extra, chosen if part is None else (chosen, part))
    chosen, parts = ways[-1][wanted][1], []
    while chosen:
        chosen, part = chosen
        parts.append(part)
    return parts[::-1]


def _cells(nodes: DataFrame, orders: list[list[int]], parts: list[tuple[int, int, int, int]]) -> DataFrame:
    """cell (partition and value), role (0: is there; 1: probes from nearby), node, n, check (words) of every node in every cell that it is in or probes."""

    def run(batches):
        for b in batches:
            words = _words(b.column(2))
            bits = [permuted(np.ascontiguousarray(words[:, w]), orders[w]) for w in range(WORDS)]
            checks = [pa.array(np.ascontiguousarray(words[:, WORDS + k]).view(np.int64)) for k in range(CHECK)]
            for k, (word, first, width, t) in enumerate(parts):
                own = bits[word] >> np.uint64(first) & np.uint64((1 << width) - 1) | np.uint64(k << 32)
                for mask in [0, *(1 << x for x in range(width if t else 0))]:
                    yield pa.RecordBatch.from_arrays([pa.array((own ^ np.uint64(mask)).view(np.int64)), pa.array(np.full(len(own), int(mask != 0), np.int32)), b.column(0), b.column(1), *checks], ["cell", "role", "node", "n", *[f"check{k}" for k in range(CHECK)]])

    checks = ", ".join(f"check{k} long" for k in range(CHECK))
    return nodes.select("node", "n", "fp").mapInArrow(run, f"cell long, role int, node binary, n int, {checks}")


def _groups(batches, keys: list[str]):
    """The rows of the batches, sorted by keys, as tables of whole groups."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        last = np.zeros(t.num_rows, bool)
        for c in keys:
            v = np.array(t.column(c).to_pylist(), object) if pa.types.is_binary(t.column(c).type) else t.column(c).to_numpy()
            last |= v != v[-1]
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _compared(cells: DataFrame, large: DataFrame) -> DataFrame:
    """a, b, d: of each node in each cell its nearest partner, d bits away, and (d null) spanning forests of all partners. large: cell, rows."""
    limit, keys = check_bits(), ["cell", "block"]
    blocks = F.coalesce(_blocks(F.col("rows"), F.lit(CELL_ROWS // 2)), F.lit(1))
    dealt = cells.join(large, "cell", "left").withColumn("mine", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # side: -1 in a block with itself; else rows of 0 are compared with rows of 1
    side = F.when(F.col("mine") == F.col("other"), -1).otherwise((F.col("mine") > F.col("other")).cast("int"))
    dealt = dealt.select(*cells.columns, (F.shiftleft(F.least("mine", "other").cast("long"), 32) + F.greatest("mine", "other")).alias("block"), side.alias("side"))

    def run(batches):
        for t in _groups(batches, keys):
            new = np.zeros(t.num_rows, bool)
            for c in keys:
                v = t.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            group, (role, n, side) = np.cumsum(new), (t.column(c).to_numpy() for c in ("role", "n", "side"))
            checks, n = [t.column(f"check{k}").to_numpy().view(np.uint64) for k in range(CHECK)], n.astype(np.int64)
            label, best, least = np.arange(t.num_rows), np.full(t.num_rows, -1), np.full(t.num_rows, CHECK * BITS + 1)
            sizes = np.diff(np.append(np.flatnonzero(np.concatenate(([True], new[1:]))), t.num_rows))
            for k in range(1, int(sizes.max(initial=1))):
                i = np.flatnonzero(group[k:] == group[:-k])
                j = i + k
                apart = sum(np.bitwise_count(c[i] ^ c[j]).astype(np.int64) for c in checks)
                ok = (apart <= limit) & ((role[i] == 0) | (role[j] == 0)) & ((side[i] != side[j]) | (side[i] < 0)) & (100 * np.minimum(n[i], n[j]) >= THRESHOLD * np.maximum(n[i], n[j]))
                i, j, apart = i[ok], j[ok], apart[ok]
                for x, y in ((i, j), (j, i)):
                    nearer = apart < least[x]
                    best[x[nearer]], least[x[nearer]] = y[nearer], apart[nearer]
                label = connected(label, i, j)
            node = t.column("node").combine_chunks()
            for a, b, d in ((np.flatnonzero(best >= 0), best[best >= 0], pa.array(least[best >= 0], pa.int32())), (tied := np.flatnonzero(label != np.arange(len(label))), label[tied], pa.nulls(len(tied), pa.int32()))):
                yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b)), d], ["a", "b", "d"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary, d int").distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """node and the set's hashes of each text."""

    def run(batches):
        for b in _small(batches):
            sets = [shingle_set(t.as_py()) for t in b.column(0)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), lists], ["node", "hashes"])

    return texts.select("text").mapInArrow(run, "node binary, hashes array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, ids: DataFrame, folder: str, tag: str) -> DataFrame:
    """The pairs (a, b), a written table, of at least THRESHOLD. ids: node, doc_id of a text that has it."""
    wanted = runtime.written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), folder, f"{tag}-wanted")
    which = runtime.written(ids.join(runtime.if_small(wanted), "node", "left_semi").select(F.col("doc_id").alias("wanted_id")).distinct(), folder, f"{tag}-ids")
    rows = runtime.only(docs)
    sets = _sets(rows.join(runtime.if_small(which), rows["doc_id"] == F.col("wanted_id"), "left_semi"))
    sets = runtime.written(sets.dropDuplicates(["node"]), folder, f"{tag}-sets")
    # a first set with many pairs goes to several tasks, once to each
    many = runtime.if_small(runtime.written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts")).where("parts > 1"), folder, f"{tag}-many"))
    left = pairs.join(many, "a", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))).drop("parts")
    first = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")).join(many, "a", "left")
    first = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").join(first, ["a", "part"])
    n = F.size(F.array_intersect("x", "y"))
    alike = F.lit(100) * n >= F.lit(THRESHOLD) * (F.size("x") + F.size("y") - n)
    out = runtime.written(both.where(alike).select("a", "b"), folder, f"{tag}-edges")
    runtime.delete_folder(docs.sparkSession, f"{folder}/{tag}-sets")
    return out


def _blocks(count, size):
    return F.ceil(count / size).cast("int")


def shared(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of xs and each of ys share, by products of incidence matrices of COLUMNS hashes."""
    sets = xs + ys
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashes, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # hashes of one set only are shared by none
    use = times[column] > 1
    of, column = of[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = np.zeros((len(xs), len(ys)), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + COLUMNS))
        there = np.zeros((len(sets), COLUMNS), np.float32)
        there[of[lo:hi], column[lo:hi] - first] = 1
        out += (there[: len(xs)] @ there[len(xs) :].T).astype(np.int64)
    return out


def _families_verified(members: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """a, b: links between the labels of each family's members that suffice to connect what is similar. members: node, doc_id, n, family, label."""
    sizes = members.groupBy("family", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("h"))
    top = sizes.groupBy("family").agg(F.max_by(F.struct("label", "k", "h"), F.struct("k", "label")).alias("top"), F.sum("k").alias("k"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("labels"))
    # a family of two was verified by its only pair
    blocks = lambda k, h: F.greatest(F.lit(1), _blocks(k, F.lit(BLOCK_SETS)), _blocks(h, F.lit(BLOCK_HASHES)))
    top = top.where("labels > 1 and k > 2").select("family", F.col("top.label").alias("top"), blocks(F.col("top.k"), F.col("top.h")).alias("tops"), blocks(F.col("k") - F.col("top.k"), F.col("h") - F.col("top.h")).alias("others"))
    top = runtime.written(top, folder, "unsettled")
    rows = runtime.written(members.join(runtime.if_small(top), "family").withColumn("is_top", F.col("label") == F.col("top")).drop("top"), folder, "unsettled-members")
    which = runtime.written(rows.select(F.col("doc_id").alias("wanted_id")).distinct(), folder, "unsettled-ids")
    texts = runtime.only(docs)
    sets = _sets(texts.join(runtime.if_small(which), texts["doc_id"] == F.col("wanted_id"), "left_semi")).dropDuplicates(["node"])
    # a set in pieces: a batch of rows stays small
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size("hashes") - 1)), F.lit(PIECE)), lambda at: F.slice("hashes", at + 1, F.lit(PIECE)))
    sets = runtime.written(sets.select("node", F.posexplode(pieces).alias("piece", "hashes")), folder, "unsettled-sets")
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keys, tops, others = ["family", "kind", "low", "high"], F.col("tops"), F.col("others")
    first = rows.where("is_top").withColumns({"low": at(tops), "high": every(others)}).withColumns({"kind": F.lit(1), "side": F.lit(0)})
    second = rows.where("not is_top").withColumns({"low": every(tops), "high": at(others)}).withColumns({"kind": F.lit(1), "side": F.lit(1)})
    third = rows.where("not is_top").withColumns({"mine": at(others), "other": every(others)}).withColumns({"kind": F.lit(2), "low": F.least("mine", "other"), "high": F.greatest("mine", "other"), "side": F.when(F.col("mine") == F.col("other"), 0).otherwise((F.col("mine") > F.col("other")).cast("int"))})
    columns = [*keys, "side", "label", "node"]
    dealt = first.select(*columns).union(second.select(*columns)).union(third.select(*columns)).join(sets, "node")

    def run(batches):
        for t in _groups(batches, keys):
            group: list[dict] = []
            for r in t.to_batches():
                for key, side, label, node, piece, hashes in zip(zip(*(r.column(c).to_pylist() for c in keys)), r.column("side").to_pylist(), r.column("label").to_pylist(), r.column("node").to_pylist(), r.column("piece").to_pylist(), r.column("hashes")):
                    if group and group[-1]["key"] != key:
                        yield _links(group)
                        group = []
                    if piece == 0:
                        group.append({"key": key, "side": side, "label": label, "hashes": []})
                    group[-1]["hashes"].append(hashes.values.to_numpy())
            if group:
                yield _links(group)

    found = dealt.repartition(*keys).sortWithinPartitions(*keys, "node", "piece").mapInArrow(run, "a binary, b binary")
    return runtime.written(found.distinct(), folder, "more")


def _links(group: list[dict]) -> pa.RecordBatch:
    """Edges between labels that connect those of similar sets of a group: of its two sides, or all of them where there is one."""
    sides = [[g for g in group if g["side"] == s] for s in (0, 1)]
    xs, ys = sides if sides[1] else (sides[0], sides[0])
    names = sorted({g["label"] for g in group})
    place = {v: k for k, v in enumerate(names)}
    label = np.arange(len(names))
    if xs and len(names) > 1:
        sets = [[np.concatenate(g["hashes"]) for g in s] for s in (xs, ys)]
        both = shared(*sets)
        n = [np.array([len(s) for s in x]) for x in sets]
        i, j = np.nonzero(100 * both >= THRESHOLD * (n[0][:, None] + n[1][None, :] - both))
        of = [np.array([place[g["label"]] for g in s]) for s in (xs, ys)]
        label = connected(label, of[0][i], of[1][j])
    tied = np.flatnonzero(label != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array([names[k] for k in tied], pa.binary()), pa.array([names[k] for k in label[tied]], pa.binary())], ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable by links), a row for each row of docs that has a doc_id."""
    spark = docs.sparkSession
    folder = runtime.work_folder(spark, "near-sets")
    sketches = runtime.written(_sketches(docs), folder, "sketches")
    nodes = sketches.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    nodes = runtime.written(nodes, folder, "nodes")
    ids = nodes.select("node", "doc_id")
    orders = bit_orders(nodes)
    parts = plan(nodes, orders)
    cells = _cells(nodes, orders, parts)
    large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CELL_ROWS)
    large = runtime.if_small(runtime.written(large, folder, "large"))
    met = runtime.written(_compared(cells, large), folder, "met")
    nearest = met.where("d is not null").groupBy("a").agg(F.min(F.struct("d", "b"))["b"].alias("b"))
    stars = runtime.written(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, "stars")
    links = _verified(stars, docs, ids, folder, "stars")
    found = runtime.written(components(links, f"{folder}/stars-components"), folder, "found")
    family = runtime.written(components(met.where("d is null").select("a", "b"), f"{folder}/families"), folder, "family")
    members = family.withColumnRenamed("component", "family").join(found, "node", "left").withColumn("label", F.coalesce("component", "node"))
    members = runtime.written(members.join(nodes.select("node", "doc_id", "n"), "node").select("node", "doc_id", "n", "family", "label"), folder, "members")
    more = _families_verified(members, docs, folder)
    found = components(links.union(more), f"{folder}/components")
    placed = sketches.select("doc_id", "node").join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).select("doc_id", "c")
    placed = runtime.written(placed, folder, "rows")
    named = runtime.written(placed.groupBy("c").agg(F.min("doc_id").alias("component_id")), folder, "named")
    return runtime.settled(placed.join(named, "c").select("doc_id", "component_id"), folder, "near-duplicates")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs of each group's smallest doc_id, and rows without doc_id; rows that repeat a doc_id stay or go together."""
    found = near_duplicates(docs)
    gone = runtime.fresh("gone_id", docs)
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias(gone)).distinct()
    drop = runtime.written(drop.join(stay, gone, "left_anti"), runtime.work_folder(docs.sparkSession, "duplicates"), "rows")
    return docs.join(runtime.if_small(drop), docs["doc_id"] == drop[gone], "left_anti")
