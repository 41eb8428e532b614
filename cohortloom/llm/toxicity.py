"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's n-grams of 4 to 6 folded characters (as for language identification)
are hashed into 2^22 bins; what counts is whether a bin occurs. On a bounded
sample of labelled rows, each bin's ratio is r = ln((p + a)/|p|) - ln((q + a)/|q|)
for p toxic and q other texts that have it; the FEATURES bins with the most
significant ratios are kept, scaled by r, and weighted by logistic regression.
Every text is scored whole.

Defined results: null and empty texts get the score of a text without features;
labels that are null, or without a text, teach nothing; a doc_id with several
labels counts under each; with nothing to learn from every score is 0; repeated
and null doc_ids are scored like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .language_id import folded

SIZES = (4, 5, 6)
SPACE = 22
FEATURES = 1024
#: Labelled rows of each class that training takes at most, about, and tasks that count them.
SAMPLE = 4000
TASKS = 6
SMOOTH = 0.5
_GULP = 400_000
_TURN = np.uint32(0x9E3779B1)


def grams(texts: list[str]):
    """For each size: (text number, hashed bin) of every n-gram within a text."""
    points, edges = folded(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(edges))
    h = points.copy()
    for n in range(2, SIZES[-1] + 1):
        h = h[:-1] * np.uint32(0x01000193) + points[n - 1 :]
        if n in SIZES:
            inside = doc[: len(h)] == doc[n - 1 :]
            yield doc[: len(h)][inside], ((h + np.uint32(n)) * _TURN >> np.uint32(32 - SPACE))[inside]


def _gulps(texts: list[str]):
    """Slices of whole texts with a bounded number of characters, or one text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _GULP):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


class Model:
    """bins: chosen bins; ratio, weight: for each; score = logistic(bias + sum of ratio x weight over bins that a text has)."""

    def __init__(self, bins: np.ndarray, ratio: np.ndarray, weight: np.ndarray, bias: float):
        self.bins, self.ratio, self.weight, self.bias = bins, ratio, weight, bias
        self._place: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_place": None}

    def place(self) -> np.ndarray:
        if self._place is None:
            self._place = np.full(1 << SPACE, -1, np.int16)
            self._place[self.bins] = np.arange(len(self.bins), dtype=np.int16)
        return self._place

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, feature) of each feature that each text has, once."""
        place, k, seen = self.place(), max(1, len(self.bins)), []
        for doc, h in grams(texts):
            f = place[h]
            hit = f >= 0
            seen.append(doc[hit].astype(np.int64) * k + f[hit])
        code = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        return code // k, code % k

    def scores(self, texts: list[str | None]) -> np.ndarray:
        texts = [t or "" for t in texts]
        out = np.full(len(texts), self.bias)
        for a, b in _gulps(texts):
            doc, f = self.present(texts[a:b])
            out[a:b] += np.bincount(doc, (self.ratio * self.weight)[f], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _fit(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, ratio: np.ndarray, rounds: int = 1000, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient descent; weights of the scaled features and the bias."""
    n, k = len(y), len(ratio)
    x = np.zeros((n, k), np.float32)
    x[doc, feature] = 1
    x *= ratio.astype(np.float32)
    size = float(np.sqrt((x * x).sum(axis=1).mean())) or 1.0
    x /= size
    top = np.linalg.norm(x.T @ (x @ np.ones(k, np.float32) / np.sqrt(k)))
    v = np.random.default_rng(3).normal(size=k).astype(np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        top = float(np.linalg.norm(v))
        v /= top or 1.0
    step = 1 / (top / n / 4 + 0.25 + ridge)
    w, b, pw, pb = np.zeros(k, np.float32), float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(k, np.float32), 0.0
    pb = b
    for t in range(rounds):
        m = t / (t + 3)
        zw, zb = w + m * (w - pw), b + m * (b - pb)
        g = 1 / (1 + np.exp(-np.clip(x @ zw + zb, -500, 500))) - y
        pw, pb = w, b
        w, b = zw - step * (x.T @ g.astype(np.float32) / n + ridge * zw), zb - step * float(g.mean())
    return w.astype(float) / size, b


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits a model on about SAMPLE rows of each class of labels (doc_id, toxic), 2 SAMPLE at most, whole texts of up to a million characters."""
    labels = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    sizes = dict(labels.groupBy("toxic").count().collect())
    share = F.lit(0)
    for label, n in sizes.items():
        share = F.when(F.col("toxic") == label, int(min(1.0, SAMPLE / n) * (1 << 20))).otherwise(share)
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)) < share)
    folder = runtime.work_folder(docs.sparkSession, "toxicity")
    # 2 SAMPLE distinct labels of a class at most: they can be broadcast; rows that repeat a doc_id are bounded likewise
    chosen = runtime.written(runtime.at_most(chosen.distinct(), 2 * SAMPLE, "toxic"), folder, "chosen")
    sample = runtime.only(docs).where((F.col("text") != "") & (F.length("text") <= 1_000_000)).join(F.broadcast(chosen), "doc_id")
    sample = runtime.at_most(sample.select("text", "toxic"), 2 * SAMPLE, "toxic")
    sample = runtime.written(sample.repartition(TASKS, F.xxhash64("text")), folder, "sample")

    def counted(batches):
        total, n = np.zeros((2, 1 << SPACE), np.uint16), np.zeros(2, np.int64)
        for b in batches:
            texts, y = b.column(0).to_pylist(), b.column(1).to_numpy()
            for lo, hi in _gulps(texts):
                code = np.unique(np.concatenate([doc.astype(np.int64) << SPACE | h for doc, h in grams(texts[lo:hi])]))
                for label in (0, 1):
                    total[label] += np.bincount(code[y[lo:hi][code >> SPACE] == label] & ((1 << SPACE) - 1), minlength=1 << SPACE).astype(np.uint16)
            n += np.bincount(y, minlength=2)
        # a row of fixed size for each of TASKS tasks
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n] + [pa.array([zlib.compress(t.tobytes(), 1)], pa.binary()) for t in total], ["n0", "n1", "q", "p"])

    q, p, n = np.zeros(1 << SPACE, np.float32), np.zeros(1 << SPACE, np.float32), np.zeros(2)
    for n0, n1, dq, dp in sample.mapInArrow(counted, "n0 long, n1 long, q binary, p binary").toLocalIterator():
        n += (n0, n1)
        q += np.frombuffer(zlib.decompress(dq), np.uint16)
        p += np.frombuffer(zlib.decompress(dp), np.uint16)
    if not n.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), -500.0 if not n[1] else 500.0)
    ratio = np.log((p + SMOOTH) / (n[1] + 2 * SMOOTH)) - np.log((q + SMOOTH) / (n[0] + 2 * SMOOTH))
    error = np.sqrt(1 / (p + SMOOTH) + 1 / (q + SMOOTH))
    strength = np.where(p >= 2, ratio / error, 0.0)
    bins = np.argsort(-strength, kind="stable")[:FEATURES]
    bins = np.sort(bins[strength[bins] > 1.0])
    model = Model(bins, ratio[bins], np.zeros(len(bins)), 0.0)

    def featured(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in _gulps(texts):
                doc, f = model.present(texts[lo:hi])
                parts = np.split(f, np.searchsorted(doc, np.arange(1, hi - lo)))
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<u2").tobytes() for x in parts], pa.binary()), b.column(1).slice(lo, hi - lo)], ["f", "y"])

    rows = sorted(map(tuple, sample.mapInArrow(featured, "f binary, y int").collect()))
    feats = [np.frombuffer(f, "<u2") for f, _ in rows]
    doc = np.repeat(np.arange(len(rows)), [len(f) for f in feats])
    model.weight, model.bias = _fit(doc, np.concatenate(feats).astype(np.int64), np.array([y for _, y in rows], float), model.ratio)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()))], ["doc_id", "score"])

    docs = runtime.only(docs)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
