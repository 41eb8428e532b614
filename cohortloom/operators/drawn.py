"""Fits and rank correlations of all bootstrap draws over a cohort of any size, by blocks of people.

No table has a row for each draw and person. A task makes the weights of a block's
people in all draws (see weights) and their scores whenever it needs them, and hands
on sums: products for least squares, and in each round the likelihood, score and
information of the logistic fits at each draw's coefficients.

Ranks need people of other blocks. A block's values and weights go, packed by a few
draws, to their part of the values; parts are ranked, and ranks go back to the block
in the order in which it sent the values. Equal values of a block are one. Parts have
about PART people, by bounds that lie where the values do; where a bound lies decides
no rank, as a part's base is the exact weight of all parts below it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import newton
from cohortloom.operators.weights import BLOCK, SLICE, block_weights

#: People of a part of the values, about: twice their ranks are mostly below 2 ** 16.
PART = 28_000
#: Bytes of a rank.
UNITS = (2, 4, 8)
#: Draws whose values travel together.
FEW = 16
#: Places of a block's scores that tell where a draw's bounds lie.
PLACES = 32
#: Bytes of packed values that a task of parts should have, about.
TASK = 64_000_000


@dataclass(frozen=True)
class Draws:
    """What goes along with tasks: of each draw in `at` its loading, and its mean once it is known. Scores are (z - mean) loading / scale."""

    at: np.ndarray
    loadings: np.ndarray
    centre: np.ndarray
    n: int
    draws: int
    seed: int
    scale: float
    size: int = BLOCK
    part: int = PART
    mean: np.ndarray | None = None

    def weights(self, block: int) -> np.ndarray:
        return block_weights(block, self.n, self.draws, self.seed, self.size)[self.at]

    @property
    def parts(self) -> int:
        return -(-self.n // self.part)


def dealt(rows: DataFrame, names: list[str], size: int, folder: str) -> DataFrame:
    """_block, row_pos, z, x (an array of the named columns) of rows, a block's rows in one file one after another; a written table."""
    x = F.array(*[F.col(c).cast("double") for c in names])
    k = F.col("row_pos").cast("long")
    out = rows.select(F.floor(k / size).cast("long").alias("_block"), k.alias("row_pos"), F.col("z").cast("array<double>").alias("z"), x.alias("x"))
    out.repartition("_block").sortWithinPartitions("row_pos").write.mode("overwrite").parquet(f"{folder}/blocks")
    return rows.sparkSession.read.schema(out.schema).parquet(f"{folder}/blocks")


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)


def _stretches(batches: Iterator[pa.RecordBatch], draws: Draws) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Weights (draws x rows), z less the centre, and x of the rows of a block that a batch has."""
    now, w = None, None
    for b in batches:
        block, pos = b.column(0).to_numpy(), b.column(1).to_numpy()
        z, x = _matrix(b.column(2), len(pos)) - draws.centre, _matrix(b.column(3), len(pos))
        for k in np.unique(block):
            if k != now:
                now, w = k, draws.weights(int(k))
            at = np.flatnonzero(block == k)
            yield w[:, pos[at] - k * draws.size], z[at], x[at]


def projected(z: np.ndarray, loadings: np.ndarray) -> np.ndarray:
    """loadings x rows: products summed in one order, so that equal rows have the very same score in whatever block they are."""
    out, t = np.zeros((len(loadings), len(z))), np.ascontiguousarray(z.T)
    for k in range(0, len(loadings), SLICE):
        part, total = loadings[k : k + SLICE], out[k : k + SLICE]
        step = np.empty_like(total)
        for j in range(len(t)):
            np.multiply(part[:, j, None], t[j], out=step)
            total += step
    return out


def _sent(k: int, m: np.ndarray) -> pa.RecordBatch:
    """One row: the figures (draws x cells) of the draws from place k on."""
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([m.ravel()], pa.list_(pa.float64()))], ["slice", "m"])


FIGURES = "slice long, m array<double>"


def _summed(figures: DataFrame, finish: Callable[[int, np.ndarray], pd.DataFrame], cells: int, kinds: str) -> DataFrame:
    """finish(first draw's place, draws x cells) of the sums of each slice's figures."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return finish(int(key[0]), np.sum(np.stack(pdf["m"].to_list()), axis=0).reshape(-1, cells))

    return figures.groupBy("slice").applyInPandas(run, kinds)


def _folded(rows: DataFrame, draws: Draws, task: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """FIGURES of a task's rows: the sum of task(weights, z, x), draws x cells, over its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for w, z, x in _stretches(batches, draws):
            add = task(w, z, x)
            total = add if total is None else total + add
        for k in range(0, 0 if total is None else len(total), SLICE):
            yield _sent(k, total[k : k + SLICE])

    return rows.mapInArrow(run, FIGURES)


def _table(figures: DataFrame, draws: Draws, cells: int) -> np.ndarray:
    """draws x cells: figures, of a bounded number of draws, in the driver."""
    out = np.zeros((len(draws.at), cells))
    same = lambda k, m: pd.DataFrame({"slice": [k], "m": [m.ravel()]})
    for k, m in _summed(figures, same, cells, FIGURES).collect():
        m = np.array(m, float).reshape(-1, cells)
        out[k : k + len(m)] = m
    return out


@dataclass(frozen=True)
class Products:
    """Each draw's sums: products of (1, x, u) with weights, where u is a score before its mean and scale, and odd, how many rows have a column that isn't finite."""

    xx: np.ndarray
    xu: np.ndarray
    odd: np.ndarray


def products(rows: DataFrame, draws: Draws, q: int) -> Products:
    i, j = np.triu_indices(1 + q)

    def task(w: np.ndarray, z: np.ndarray, x: np.ndarray) -> np.ndarray:
        bad = ~np.isfinite(x)
        x = np.concatenate((np.ones((len(x), 1)), np.where(bad, 0.0, x)), axis=1)
        w = w.astype(float)
        return np.concatenate((w @ (x[:, i] * x[:, j]), (w * (draws.loadings @ z.T)) @ x, w @ bad), axis=1)

    m = _table(_folded(rows, draws, task), draws, len(i) + 1 + 2 * q)
    xx = np.zeros((len(m), 1 + q, 1 + q))
    xx[:, i, j] = xx[:, j, i] = m[:, : len(i)]
    return Products(xx, m[:, len(i) : len(i) + 1 + q], m[:, len(i) + 1 + q :])


def logistic(rows: DataFrame, draws: Draws, y: int, designs: list[list[int]], status: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(statuses, coefficients of 1, the score and the columns) of each draw (a row) and design: newton's rounds, a round of all fits being one pass.

    status: draws x designs, newton.MOVING where there is something to fit; draws must have their mean.
    """
    names = [s.split()[0] for s in newton.STATE.split(", ")]
    kinds = f"place long, design long, {newton.STATE}"
    sizes = [2 + len(c) for c in designs]
    widths = [1 + p + p * (p + 1) // 2 for p in sizes]
    cuts = np.cumsum([0, *widths])
    state = {(d, k): {"beta": [0.0] * sizes[k], "value": None, "trial": [0.0] * sizes[k], "move": [0.0] * sizes[k], "size": 1.0, "status": str(status[d, k]), "info": None} for d in range(len(draws.at)) for k in range(len(designs))}
    for _ in range(newton.ROUNDS):
        moving = {key: s for key, s in state.items() if s["status"] == newton.MOVING}
        if not moving:
            break
        trials = [(np.array([d for d, k in moving if k == g], int), np.array([s["trial"] for (_, k), s in moving.items() if k == g], float)) for g in range(len(designs))]

        def task(w: np.ndarray, z: np.ndarray, x: np.ndarray, trials=trials) -> np.ndarray:
            out = np.zeros((len(w), cuts[-1]))
            x, yes = np.where(np.isfinite(x), x, 0.0), x[:, y] == 1
            for g, (places, trial) in enumerate(trials):
                fixed = np.concatenate((np.ones((len(x), 1)), x[:, designs[g]]), axis=1)
                p, q = sizes[g], fixed.shape[1]
                # the place of each fixed column among the coefficients: the score is the second
                home = np.array([0, *range(2, p)])
                i, j = np.triu_indices(q)
                pairs = fixed[:, i] * fixed[:, j]
                for k in range(0, len(places), SLICE):
                    at, b = places[k : k + SLICE], trial[k : k + SLICE]
                    m, s = w[at], (draws.loadings[at] @ z.T - draws.mean[at, None]) / draws.scale
                    eta = b[:, home] @ fixed.T + b[:, 1, None] * s
                    e = np.exp(-np.abs(eta))
                    prob = np.where(eta >= 0, 1.0, e) / (1 + e)
                    # log(1 + exp(-eta)) of the ones, log(1 + exp(eta)) of the zeros
                    value = -(m * (np.log1p(e) + np.maximum(np.where(yes, -eta, eta), 0.0))).sum(axis=1)
                    r, v = m * (yes - prob), m * prob * (1 - prob)
                    score, info = np.zeros((len(at), p)), np.zeros((len(at), p, p))
                    score[:, home], score[:, 1] = r @ fixed, (r * s).sum(axis=1)
                    info[:, home[i], home[j]] = v @ pairs
                    info[:, 1, 1] = (v * s * s).sum(axis=1)
                    cross = (v * s) @ fixed
                    info[:, 0, 1], info[:, 1, 2:] = cross[:, 0], cross[:, 1:]
                    up = np.triu_indices(p)
                    out[at, cuts[g] : cuts[g + 1]] = np.concatenate((value[:, None], score, info[:, up[0], up[1]]), axis=1)
            return out

        def finish(first: int, m: np.ndarray, moving=moving) -> pd.DataFrame:
            after = []
            for d in range(first, first + len(m)):
                for g, p in enumerate(sizes):
                    if (d, g) in moving:
                        own = m[d - first, cuts[g] : cuts[g + 1]]
                        a, up = np.zeros((p, p)), np.triu_indices(p)
                        a[up] = a.T[up] = own[1 + p :]
                        new = newton._advanced(moving[d, g] | {"_l": float(own[0]), "_g": own[1 : 1 + p], "_a": a}, p)
                        after.append((d, g, *(new[c] for c in names)))
            return pd.DataFrame(after, columns=["place", "design", *names])

        for r in _summed(_folded(rows, draws, task), finish, int(cuts[-1]), kinds).collect():
            state[r["place"], r["design"]] = {c: r[c] for c in names}
    found = np.array([[state[d, k]["status"] for k in range(len(designs))] for d in range(len(draws.at))], object).reshape(len(draws.at), len(designs))
    found[found == newton.MOVING] = "no convergence"
    beta = [np.array([state[d, k]["beta"] for d in range(len(draws.at))], float).reshape(-1, sizes[k]) for k in range(len(designs))]
    return found, beta


# --- ranks


def _distinct(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of v, each draw's weight of each, and every row's place among them."""
    own, back = np.unique(v, axis=0, return_inverse=True)
    back = back.ravel()
    order = np.argsort(back, kind="stable")
    return own, np.add.reduceat(w[:, order], np.searchsorted(back[order], np.arange(len(own))), axis=1), back


@dataclass(frozen=True)
class _Variable:
    """A block's distinct values (of each draw, or of all), each draw's weights of them, the parts they lie in, and where each row is among them."""

    values: np.ndarray
    weights: np.ndarray
    parts: np.ndarray
    back: np.ndarray

    def chosen(self, k: int, part: int) -> np.ndarray:
        """Draws x values: which values of a part the draws from k on have."""
        return (self.parts == part if self.values.ndim == 1 else self.parts[k : k + FEW] == part) & (self.weights[k : k + FEW] > 0)


def _variables(draws: Draws, w: np.ndarray, z: np.ndarray, x: np.ndarray, ranked: list[int], bounds: list[np.ndarray]) -> list[_Variable]:
    """The score's and the ranked columns' values of a block. bounds: of the score draws x bounds, of a column its bounds."""
    own, m, back = _distinct(z, w)
    u = projected(own, draws.loadings)
    parts = np.zeros(u.shape, np.int32)
    if bounds[0].shape[1]:
        for d in range(len(u)):
            parts[d] = np.searchsorted(bounds[0][d], u[d], side="right")
    out = [_Variable(u, m, parts, back)]
    for c, b in zip(ranked, bounds[1:]):
        own, m, back = _distinct(np.where(np.isfinite(x[:, c]), x[:, c], 0.0) + 0.0, w)
        out.append(_Variable(own, m, np.searchsorted(b, own, side="right"), back))
    return out


def _block(t: pa.Table, draws: Draws) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number, weights, z less the centre and x of a whole block, in the order of its rows."""
    t = t.sort_by("row_pos")
    block, pos = t.column("_block")[0].as_py(), t.column("row_pos").to_numpy()
    return block, draws.weights(block)[:, pos - block * draws.size], _matrix(t.column("z"), len(pos)) - draws.centre, _matrix(t.column("x"), len(pos))


def _bounds(rows: DataFrame, draws: Draws, ranked: list[int]) -> list[np.ndarray]:
    """Bounds of the parts: of the score, draws x bounds, from places of each block's scores; of columns from approximate percentiles. One part has none."""
    shares = np.arange(1, draws.parts) / draws.parts
    if not len(shares):
        return [np.zeros((len(draws.at), 0)), *[np.zeros(0)] * len(ranked)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, z, _ in _stretches(batches, draws):
            u = np.sort(projected(z, draws.loadings), axis=1)[:, np.linspace(0, len(z) - 1, PLACES).astype(int)]
            for k in range(0, len(u), SLICE):
                yield _sent(k, u[k : k + SLICE])

    def pooled(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        u = np.concatenate([np.asarray(m).reshape(-1, PLACES) for m in pdf["m"]], axis=1)
        return pd.DataFrame({"slice": [key[0]], "m": [np.quantile(u, shares, axis=1).T.ravel()]})

    score = np.zeros((len(draws.at), len(shares)))
    for k, m in rows.mapInArrow(run, FIGURES).groupBy("slice").applyInPandas(pooled, FIGURES).collect():
        m = np.array(m, float).reshape(-1, len(shares))
        score[k : k + len(m)] = m
    v = [F.when(F.abs(F.col("x")[c]) < float("inf"), F.col("x")[c]) for c in ranked]
    cuts = rows.agg(*[F.percentile_approx(c, shares.tolist()) for c in v]).first()
    return [score, *[np.array(c or [], float) for c in cuts]]


def _bases(rows: DataFrame, draws: Draws, ranked: list[int], bounds: list[np.ndarray]) -> np.ndarray:
    """draws x variables x parts: each draw's weight of all lower parts."""
    n, parts = 1 + len(ranked), draws.parts
    if parts == 1:
        return np.zeros((len(draws.at), n, 1))

    def task(w: np.ndarray, z: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(w), n, parts))
        for k, v in enumerate(_variables(draws, w, z, x, ranked, bounds)):
            for part in range(parts):
                out[:, k, part] = (v.weights * (v.parts == part)).sum(axis=1)
        return out.reshape(len(w), -1)

    m = _table(_folded(rows, draws, task), draws, n * parts).reshape(-1, n, parts)
    return np.cumsum(m, axis=2) - m


PIECE = pa.schema([("variable", pa.int32()), ("slice", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("unit", pa.int32()), ("counts", pa.binary()), ("vals", pa.binary()), ("weights", pa.binary())])
PIECES = "variable int, slice int, part int, block long, unit int, counts binary, vals binary, weights binary"
RANKED = "block long, variable int, slice int, part int, ranks binary"


def _pieces(block: int, variables: list[_Variable], draws: Draws) -> pa.Table:
    """A block's values and weights, by variable, FEW draws and part. Of common values the weights of all draws, of scores how many each draw has."""
    out = []
    for n, v in enumerate(variables):
        unit = 1 if v.weights.max() < 256 else 4
        m = v.weights.astype(f"<u{unit}")
        for k in range(0, len(draws.at), FEW):
            for part in np.unique(v.parts if v.values.ndim == 1 else v.parts[k : k + FEW]).tolist():
                at = v.chosen(k, part)
                if not at.any():
                    continue
                if v.values.ndim == 1:
                    all_ = v.parts == part
                    out.append((n, k, part, block, unit, None, v.values[all_].tobytes(), m[k : k + FEW][:, all_].tobytes()))
                else:
                    out.append((n, k, part, block, unit, at.sum(axis=1).astype("<i4").tobytes(), v.values[k : k + FEW][at].tobytes(), m[k : k + FEW][at].tobytes()))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), PIECE)], PIECE) if out else PIECE.empty_table()


def _doubled_ranks(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Twice the average ranks within a part of sorted values (weights: draws x values), less those of lower parts: whole numbers."""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    tied = np.add.reduceat(weights, starts, axis=1)
    r = 2 * (np.cumsum(tied, axis=1) - tied) + tied + 1
    return np.repeat(r, np.diff(np.append(starts, len(values))), axis=1)


def _rank_part(t: pa.Table) -> pa.Table:
    """RANKED rows of all pieces of a part: twice the ranks of the values that draws have, in as few bytes as they need."""
    units, blocks = t.column("unit").to_pylist(), t.column("block").to_pylist()
    values = [np.frombuffer(b.as_py(), "<f8") for b in t.column("vals")]
    weights = [np.frombuffer(b.as_py(), f"<u{u}").astype(np.int64) for b, u in zip(t.column("weights"), units)]
    ends = np.cumsum([len(v) for v in values])[:-1]
    v = np.concatenate(values)
    if t.column("variable")[0].as_py():
        order = np.argsort(v, kind="stable")
        w = np.concatenate([w.reshape(-1, len(x)) for w, x in zip(weights, values)], axis=1)
        made = np.empty(w.shape, np.int64)
        made[:, order] = _doubled_ranks(v[order], w[:, order])
        parts = [r[m > 0] for r, m in zip(np.split(made, ends, axis=1), np.split(w, ends, axis=1))]
    else:
        counts = [np.frombuffer(b.as_py(), "<i4") for b in t.column("counts")]
        draw = np.concatenate([np.repeat(np.arange(len(c)), c) for c in counts])
        w, made = np.concatenate(weights), np.empty(len(v), np.int64)
        order = np.lexsort((v, draw))
        cuts = np.searchsorted(draw[order], np.arange(FEW + 1))
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low < high:
                at = order[low:high]
                made[at] = _doubled_ranks(v[at], w[None, at])[0]
        parts = np.split(made, ends)
    same = [t.column(c).combine_chunks() for c in ("variable", "slice", "part")]
    least = [next(u for u in UNITS if r.max(initial=0) < 1 << 8 * u) for r in parts]
    return pa.table([pa.array(blocks, pa.int64()), *same, pa.array([r.astype(f"<u{u}").tobytes() for r, u in zip(parts, least)], pa.binary())], ["block", "variable", "slice", "part", "ranks"])


def rank_products(rows: DataFrame, draws: Draws, ranked: list[int], plain: list[int], finish: Callable[[int, np.ndarray], pd.DataFrame], kinds: str) -> DataFrame:
    """finish(first draw's place, draws x p x p) of each draw's weighted products of 1, the plain columns and the ranks, less their
    mean, of the score and the ranked columns. Columns must be finite; others count as 0, and products() tells where."""
    bounds = _bounds(rows, draws, ranked)
    bases = _bases(rows, draws, ranked, bounds)
    p = 2 + len(plain) + len(ranked)

    def send(t: pa.Table) -> pa.Table:
        block, w, z, x = _block(t, draws)
        return _pieces(block, _variables(draws, w, z, x, ranked, bounds), draws)

    # a draw has about 0.63 of all people: a value and a weight of the score, and a weight of each column; their ranks are less
    bytes_ = draws.n * len(draws.at) * (0.63 * 9 + len(ranked))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(bytes_ / TASK))
    keys = ["variable", "slice", "part"]
    sent = rows.groupBy("_block").applyInArrow(send, PIECES).repartition(tasks, *keys)
    back = sent.groupBy(*keys).applyInArrow(_rank_part, RANKED).repartition(tasks, "block")

    def join(t: pa.Table, r: pa.Table) -> pa.Table:
        _, w, z, x = _block(t, draws)
        variables = _variables(draws, w, z, x, ranked, bounds)
        found = {(n, k, part): b.as_py() for n, k, part, b in zip(*(r.column(c).to_pylist() for c in keys), r.column("ranks"))}
        out = []
        x = np.where(np.isfinite(x), x, 0.0)
        for k in range(0, len(draws.at), FEW):
            m = w[k : k + FEW].astype(float)
            table = np.zeros((len(m), p, m.shape[1]))
            table[:, 0], table[:, 1 : 1 + len(plain)] = 1.0, x[:, plain].T
            for n, v in enumerate(variables):
                ranks = np.zeros((len(m), v.weights.shape[1]))
                for part in range(draws.parts):
                    if (n, k, part) in found:
                        at = v.chosen(k, part)
                        counts, b = at.sum(axis=1), found[n, k, part]
                        ranks[at] = np.frombuffer(b, f"<u{len(b) // counts.sum()}") / 2 + np.repeat(bases[k : k + FEW, n, part], counts)
                table[:, 1 + len(plain) + n] = ranks[:, v.back] - (draws.n + 1) / 2
            out.append((table * m[:, None]) @ table.transpose(0, 2, 1))
        out = np.concatenate(out).reshape(len(draws.at), -1)
        return pa.Table.from_batches([_sent(k, out[k : k + SLICE]) for k in range(0, len(out), SLICE)])

    figures = rows.groupBy("_block").cogroup(back.groupBy("block")).applyInArrow(join, FIGURES)
    return _summed(figures, lambda k, m: finish(k, m.reshape(-1, p, p)), p * p, kinds)


def known_draws(loadings: DataFrame, centre: np.ndarray, n: int, draws: int, seed: int, scale: float, most: int, size: int = BLOCK, part: int = PART) -> Draws:
    """Draws of a table of draw, loading: those that have one. Their loadings have at most `most` entries."""
    known = {r["draw"]: r["loading"] for r in loadings.where("loading is not null").select("draw", "loading").collect()}
    if sum(map(len, known.values())) > most:
        raise ValueError("the loadings of all draws are too large a bundle")
    at = np.array(sorted(known), int)
    return Draws(at, np.array([known[d] for d in at.tolist()], float).reshape(len(at), -1), np.asarray(centre, float), n, draws, seed, scale, size, part)


def with_means(draws: Draws, p: Products) -> Draws:
    return replace(draws, mean=p.xu[:, 0] / p.xx[:, 0, 0])
