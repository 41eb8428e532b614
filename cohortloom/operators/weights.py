"""Bootstrap draws as multinomial weights that every task makes for its own rows.

A draw gives n rows with replacement, so that row k has a weight, and all weights
of a draw add up to n. Rows are numbered from 0 and dealt in blocks. How many of
a draw's n rows fall into a block follows from a tree: the root has n; a node's
count is split over its halves by a binomial of their numbers of rows; a block's
count is dealt over its rows by a multinomial. That is the multinomial over all
rows, exactly. Each node's generator is keyed by the seed and the node alone, so
any task can make any block's weights, again and again, from log(blocks) vectors
of one number a draw: no table of draws is made, shipped or joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.contracts import ContractError
from cohortloom.operators.pattern import Degenerate, component_of_moments, moments
from cohortloom.operators.ranking import numbered
from cohortloom.sources.workspace import written

#: Rows of a block: weights of a block, draws x BLOCK integers, are in memory at once.
BLOCK = 1024
#: Draws whose moments a task hands on at once.
SLICE = 128


def _generator(seed: int, a: int, b: int) -> np.random.Generator:
    """The generator of the node that has blocks a to b (a leaf's: a to a)."""
    return np.random.Generator(np.random.Philox(key=np.array([seed, a << 32 | b], np.uint64)))


def block_weights(block: int, n: int, draws: int, seed: int, size: int = BLOCK) -> np.ndarray:
    """draws x rows of the block: how often each row is drawn."""
    low, high = 0, -(-n // size)
    count = np.full(draws, n, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        rows, left = min(high * size, n) - low * size, mid * size - low * size
        part = _generator(seed, low, high).binomial(count, left / rows)
        count, low, high = (part, low, mid) if block < mid else (count - part, mid, high)
    m = min(size, n - block * size)
    return _generator(seed, block, block).multinomial(count, np.full(m, 1 / m))


def weights(spark: SparkSession, n: int, draws: int, seed: int, size: int = BLOCK) -> DataFrame:
    """draw, row_pos, weight of every row that a draw has, of rows 0 to n - 1; each block is made by the task that has it.

    A join sorts it: Spark takes it for as small as the range of blocks that it is made from, and would send all draws through the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0).to_pylist():
                w = block_weights(block, n, draws, seed, size)
                for k in range(0, draws, SLICE):
                    draw, pos = np.nonzero(w[k : k + SLICE])
                    yield pa.RecordBatch.from_arrays([pa.array(draw + k), pa.array(pos + block * size), pa.array(w[k : k + SLICE][draw, pos])], ["draw", "row_pos", "weight"])

    return spark.range(-(-n // size)).mapInArrow(run, "draw long, row_pos long, weight long").hint("merge")


def weight_vectors(rows: DataFrame, at: str, n: int, draws: int, seed: int, size: int = BLOCK) -> DataFrame:
    """rows with w, how often each draw has the row: an array by draw. at: the column of row numbers from 0 to n - 1, whose block's task makes them; a number may come many times."""
    names = [c for c in rows.columns if c != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, w = None, None
        for b in batches:
            pos = b.column(0).to_numpy()
            # rows come in order: a block's rows are one stretch
            cuts = np.flatnonzero(np.diff(pos // size)) + 1
            for low, high in zip((0, *cuts), (*cuts, len(pos))):
                if low == high:
                    continue
                block = int(pos[low] // size)
                if block != now:
                    now, w = block, block_weights(block, n, draws, seed, size).T.astype(np.int32)
                ends = pa.array(np.arange(high - low + 1) * draws, pa.int32())
                made = pa.ListArray.from_arrays(ends, pa.array(w[pos[low:high] - block * size].ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(low, high - low) for k in range(1, b.num_columns)], made], [*names, "w"])

    kinds = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes if c != at), "w array<int>"])
    dealt = rows.select(F.col(at).cast("long").alias(at), *names).withColumn("_block", F.floor(F.col(at) / size)).repartition("_block").sortWithinPartitions(at).drop("_block")
    return dealt.mapInArrow(run, kinds)


def _triangle(p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(p)


def weighted_moments(rows: DataFrame, centre: np.ndarray, n: int, draws: int, seed: int, size: int = BLOCK) -> DataFrame:
    """draw, m: of each draw's rows the number, the sum and the upper triangle of the products of z - centre, summed over a task's blocks.

    rows: row_pos from 0 to n - 1, each once, and z, an array as long as centre. A task keeps and emits one
    vector a draw, whatever the number of its rows.
    """
    p = len(centre)
    i, j = _triangle(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now, w = None, None, None
        for b in batches:
            pos = b.column(0).to_numpy()
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(pos), -1) - centre
            if not np.isfinite(x).all():
                raise ValueError("all components must be finite numbers")
            total = np.zeros((draws, 1 + p + len(i))) if total is None else total
            for block in np.unique(pos // size):
                if block != now:
                    now, w = block, block_weights(int(block), n, draws, seed, size).astype(float)
                at = np.flatnonzero(pos // size == block)
                z = x[at]
                total += w[:, pos[at] - block * size] @ np.concatenate((np.ones((len(at), 1)), z, z[:, i] * z[:, j]), axis=1)
        for k in range(0, draws if total is not None else 0, SLICE):
            part = total[k : k + SLICE]
            ends = pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part))), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], ["draw", "m"])

    block = F.floor(F.col("row_pos") / size)
    dealt = rows.select("row_pos", "z", block.alias("_block")).repartition("_block").sortWithinPartitions("row_pos").select(F.col("row_pos").cast("long"), F.col("z").cast("array<double>"))
    return dealt.mapInArrow(run, "draw long, m array<double>")


COMPONENT = "draw long, loading array<double>, eigen1 double, eigen2 double, explained double, cosine double, near_tie boolean, ambiguous boolean, degenerate boolean"


def _components(summed: DataFrame, loading: np.ndarray, p: int) -> DataFrame:
    """COMPONENT of each draw's vectors of moments (draw, m)."""
    i, j = _triangle(p)
    length = float(np.linalg.norm(loading))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.sum(np.stack(pdf["m"].to_list()), axis=0)
        products = np.zeros((p, p))
        products[i, j] = products[j, i] = m[1 + p :]
        row = {"draw": key[0], "degenerate": False}
        try:
            f = component_of_moments(m[0], m[1 : 1 + p], products)
        except Degenerate:
            return pd.DataFrame([row | dict.fromkeys(("loading", "eigen1", "eigen2", "explained", "cosine", "near_tie", "ambiguous")) | {"degenerate": True}])
        dot = float(f["loading"] @ loading)
        return pd.DataFrame([row | {"loading": (f["loading"] * (-1 if dot < 0 else 1)).tolist(), "eigen1": f["eigen1"], "eigen2": f["eigen2"], "explained": f["explained"], "cosine": abs(dot) / length, "near_tie": f["eigen1"] - f["eigen2"] <= 1e-10 * f["eigen1"], "ambiguous": abs(dot) <= 1e-12}])

    return summed.groupBy("draw").applyInPandas(one, COMPONENT)


def component_draws(rows: DataFrame, loading: np.ndarray, centre: np.ndarray, n: int, draws: int, seed: int, size: int = BLOCK) -> DataFrame:
    """COMPONENT of each of `draws` bootstrap draws of the rows (row_pos, z): the first component of its weighted covariance, its sign
    that of its product with `loading`. Degenerate draws stay, as nulls.

    A draw's task has one vector of moments from each task of rows. Loadings come from products: eigenvalues have an
    absolute error of about 1e-16 times the largest product.
    """
    return _components(weighted_moments(rows, centre, n, draws, seed, size), loading, len(centre))


def stratified_component_draws(rows: DataFrame, stratum: str, reference: np.ndarray, draws: int, seed: int, size: int = BLOCK, most: int = 64) -> DataFrame:
    """COMPONENT of draws that keep every stratum's number of rows; written once. rows: row_pos, z and the stratum's column.

    Strata, at most `most` of them, are drawn one by one in their order, the k-th with the seed plus k, and a draw's moments are
    the sums of theirs. The rows' own component must be the reference (of length 1, up to sign) to 1e-9, and a draw without
    a component fails the whole: it is neither redrawn nor left out. Rows without a stratum fail too.
    """
    reference = np.asarray(reference, float)
    whole = component_of_moments(*moments(rows.select("z"), "z"))
    seen = whole["loading"] * (-1 if whole["loading"] @ reference < 0 else 1)
    if abs(np.linalg.norm(reference) - 1) > 1e-12 or not np.allclose(seen, reference, rtol=0, atol=1e-9):
        raise ContractError("the rows' own component isn't the reference")
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).orderBy(stratum).limit(most + 1).collect()
    if len(sizes) > most or any(r[0] is None for r in sizes):
        raise ContractError(f"over {most} strata, or rows without one")
    placed = written(numbered(rows.select("row_pos", "z", stratum), [stratum], "row_pos", [], "_k").select(stratum, (F.col("_k") - 1).alias("row_pos"), "z"), "strata")
    parts = [weighted_moments(placed.where(F.col(stratum) == F.lit(r[0])), whole["centre"], int(r["n"]), draws, seed + k, size) for k, r in enumerate(sizes)]
    out = written(_components(reduce(DataFrame.unionByName, parts), reference, len(reference)), "stratified")
    lost = out.where("degenerate").agg(F.min("draw"), F.count(F.lit(1))).first()
    if lost[1]:
        raise ContractError(f"{lost[1]} draws have no component, draw {lost[0]} first")
    return out
