"""Hierarchical language identification with linear support vector machines.

A text's character bigrams and trigrams (letters folded to lower case, all else
a space) are counted in 2^13 hashed bins; the vector of the square roots of
their shares goes to one-versus-one linear SVMs, first between the languages'
families, then between the languages of the winning family. The SVMs are fitted
in the driver on about SAMPLE documents of each language, 2 SAMPLE rows at most,
chosen by hashes, as sparse rows; every text is classified whole.

Defined results: `und`, score 0, for null texts, texts without a letter, and
where there is nothing to learn from; null lang is never learned; repeated and
null doc_ids are predicted like any other; languages that FAMILIES doesn't have
are families of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
}
SAMPLE = 600
BINS = 1 << 13
_GULP = 500_000

_tables: dict[str, np.ndarray] = {}


def _fold_table() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else a space."""
    if "fold" not in _tables:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables["fold"] = table
    return _tables["fold"]


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each between spaces, and where each begins (and the last ends)."""
    joined = "".join(f" {t} " for t in texts)
    points = _fold_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return points, np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts])))


def counts(texts: list[str]) -> np.ndarray:
    """Texts x BINS: how often each hashed bigram and trigram occurs; grams that begin with two spaces are left out."""
    points, edges = folded(texts)
    out = np.zeros((len(texts), BINS), np.float32)
    mask = np.uint32(BINS - 1)
    a, b = points[:-1], points[1:]
    two = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(7) & mask
    three = (a[:-1] * np.uint32(0x27D4EB2F) + b[:-1] * np.uint32(0x165667B1) + points[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(9) & mask
    blank = (a == 32) & (b == 32)
    for k in range(len(texts)):
        lo, hi = int(edges[k]), int(edges[k + 1])
        for grams, n in ((two, 2), (three, 3)):
            part = grams[lo : hi - n + 1]
            part = part[~blank[lo : lo + len(part)]]
            if len(part):
                out[k] += np.bincount(part, minlength=BINS)
    return out


def vectors(texts: list[str]) -> np.ndarray:
    x = counts(texts)
    return np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))


#: A sparse row: places of entries other than 0, and the entries.
Row = tuple[np.ndarray, np.ndarray]


def rooted(at: np.ndarray, n: np.ndarray) -> Row:
    """The square roots of the shares of counts n at places `at`."""
    return at.astype(np.int64), np.sqrt(n / max(1, n.sum()))


def fit_svm(rows: list[Row], y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights, bias last, of a linear SVM (hinge loss; dual coordinate descent) for y of +1 and -1."""
    norm, alpha, w, bias = np.array([v @ v + 1 for _, v in rows]), np.zeros(len(rows)), np.zeros(BINS), 0.0
    turn = np.random.default_rng(7)
    # both classes weigh the same
    cap = np.where(y > 0, len(y) / max(1, (y > 0).sum()), len(y) / max(1, (y < 0).sum())) * c / 2
    for _ in range(epochs):
        moved = 0.0
        for i in turn.permutation(len(rows)):
            at, v = rows[i]
            new = min(max(alpha[i] - (y[i] * (w[at] @ v + bias) - 1) / norm[i], 0.0), cap[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                bias += (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * c:
            break
    return np.append(w, bias)


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes.split()), lang)


class Model:
    """Decisions of a two-level tree: between families, then within one."""

    def __init__(self, x: list[Row], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(v) for v in self.langs})
        y, f = np.array(langs), np.array([family(v) for v in langs])
        self.pairs: list[tuple[str, str, str]] = [("", a, b) for a, b in combinations(self.families, 2)]
        self.pairs += [(g, a, b) for g in self.families for a, b in combinations([v for v in self.langs if family(v) == g], 2)]
        rows = []
        for level, a, b in self.pairs:
            label = y if level else f
            use = (label == a) | (label == b)
            rows.append(fit_svm([x[k] for k in np.flatnonzero(use)], np.where(label[use] == a, 1.0, -1.0)))
        self.weights = np.array(rows).T if rows else np.zeros((BINS + 1, 0))

    def _vote(self, margins: np.ndarray, level: str, names: list[str]) -> tuple[str, float]:
        """The name with most pairwise wins (then the largest sum of margins), and the chance of its closest decision."""
        score, closest = dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for (where, a, b), m in zip(self.pairs, margins):
            if where == level and a in score and b in score:
                for name, s in ((a, m), (b, -m)):
                    score[name] += (s > 0) + 1e-3 * np.tanh(s)
                    closest[name] = min(closest[name], s)
        best = max(names, key=lambda n: score[n])
        return best, 1.0 if closest[best] == np.inf else float(1 / (1 + np.exp(-3 * closest[best])))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        some = [k for k, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        at = 0
        while at < len(some):  # a bounded number of characters at a time, but whole texts
            end, size = at, 0
            while end < len(some) and end - at < 200 and (end == at or size + len(texts[some[end]]) <= _GULP):
                size += len(texts[some[end]])
                end += 1
            margins = vectors([texts[k] for k in some[at:end]]) @ self.weights[:-1].astype(np.float32) + self.weights[-1]
            for k, m in zip(some[at:end], margins):
                group, p = self._vote(m, "", self.families)
                lang, q = self._vote(m, group, [v for v in self.langs if family(v) == group])
                out[k] = (lang, p * q)
            at = end
        return out


def train(labelled: DataFrame) -> Model:
    """Fits a model on a bounded sample of labelled (doc_id, text, lang)."""
    labelled = labelled.where("text is not null and lang is not null")
    sizes = dict(labelled.groupBy("lang").count().collect())  # a row for each language
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, SAMPLE / n) * (1 << 20))).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < share).select("text", "lang")
    sample = runtime.at_most(sample, 2 * SAMPLE, "lang")

    def run(batches):
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = counts([text])[0]
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([c[at].astype("<f4").tobytes()], pa.binary())], ["lang", "at", "n"])

    rows = sorted(map(tuple, sample.mapInArrow(run, "lang string, at binary, n binary").collect()))
    x = [rooted(np.frombuffer(at, "<u2"), np.frombuffer(n, "<f4")) for _, at, n in rows]
    some = [k for k, (at, _) in enumerate(x) if len(at)]
    return Model([x[k] for k in some], [rows[k][0] for k in some])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs."""

    def run(batches):
        for b in batches:
            found = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v for v, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = runtime.only(docs)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
