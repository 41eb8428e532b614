"""Elastic-net logistic regression with certificates, as a NumPy kernel for one small problem.

Objective: mean log-loss + a sum|b| + (b'b) c / 2 over penalized coefficients,
a = l1 / (C n), c = (1 - l1) / (C n); the intercept and unpenalized columns
carry no penalty. Each outer step minimizes the penalized quadratic model by
coordinate descent, then exactly on the support that it found, and goes along
the line to it as far as the gain keeps up with what the slope promises. A fit counts only with its first-order residual and its
duality gap within fixed bounds.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Fixed bounds of acceptance.
TARGET, ACCEPT, GAP, BALANCE = 1e-11, 1e-8, 1e-10, 1e-12


class NotCertified(ArithmeticError):
    """A fit that doesn't meet its bounds; never replaced by another method's."""


class Fit(NamedTuple):
    intercept: float
    coef: np.ndarray
    kkt: float
    gap: float
    objective: float
    steps: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _expit(self.intercept + x @ self.coef)


def _expit(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def _shrink(v, by):
    return np.sign(v) * np.maximum(np.abs(v) - by, 0)


class _Problem:
    def __init__(self, x: np.ndarray, y: np.ndarray, a: np.ndarray, c: np.ndarray):
        self.x, self.y, self.a, self.c = np.hstack([np.ones((len(x), 1)), x]), y, a, c

    def value(self, w: np.ndarray) -> float:
        z = self.x @ w
        loss = np.logaddexp(0, np.where(self.y > 0, -z, z)).mean()
        return float(loss + self.a @ np.abs(w) + self.c @ (w * w) / 2)

    def slope(self, w: np.ndarray) -> np.ndarray:
        return self.x.T @ (_expit(self.x @ w) - self.y) / len(self.y) + self.c * w

    def residual(self, w: np.ndarray, g: np.ndarray) -> float:
        return float(np.max(np.abs(np.where(w != 0, g + self.a * np.sign(w), _shrink(g, self.a)))))

    def gap(self, w: np.ndarray) -> tuple[float, float]:
        """(primal less dual value, largest violation of the unpenalized columns' balance)."""
        r = self.y - _expit(self.x @ w)
        score = self.x.T @ r / len(r)
        strict = (self.c == 0) & (self.a > 0)  # the dual must keep these scores within a
        top = np.max(np.abs(score[strict]) / self.a[strict], initial=0.0)
        r = r * (1 if top <= 1 else (1 - 1e-15) / top)
        score = self.x.T @ r / len(r)
        q = np.clip(self.y - r, 0, 1)
        entropy = -np.mean(np.where(q > 0, q * np.log(np.where(q > 0, q, 1)), 0) + np.where(q < 1, (1 - q) * np.log(np.where(q < 1, 1 - q, 1)), 0))
        ridge = self.c > 0
        conjugate = np.sum(_shrink(score[ridge], self.a[ridge]) ** 2 / (2 * self.c[ridge]))
        free = (self.a == 0) & (self.c == 0)
        return self.value(w) - float(entropy - conjugate), float(np.max(np.abs(score[free]), initial=0.0))

    def along(self, w: np.ndarray, value: float, g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, float] | None:
        """(point, value) of the longest of d, d / 2, .. that gains a tenth of what the slope along it promises; None if none does.

        Where the promise is smaller than values can tell apart, the whole step counts if it lowers the first-order residual.
        """
        promise = float(g @ d + self.a @ (np.abs(w + d) - np.abs(w)))
        if promise > -1e-13 * (1 + abs(value)):
            whole = w + d
            return (whole, self.value(whole)) if self.residual(whole, self.slope(whole)) < self.residual(w, g) else None
        for share in 0.5 ** np.arange(40):
            here = self.value(w + share * d)
            if here <= value + 0.1 * share * promise:
                return w + share * d, here
        return None

    def model_minimum(self, w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The minimizer of the quadratic model at w plus the absolute values."""
        taxed = self.a > 0

        def solved(signs: np.ndarray) -> tuple[np.ndarray, bool]:
            """(the model's minimum over points whose penalized entries have these signs, whether it has them itself)."""
            on = (signs != 0) | ~taxed
            point = np.zeros_like(w)
            point[on] = np.linalg.lstsq(h[np.ix_(on, on)], (h @ w - g - self.a * signs)[on], rcond=None)[0]
            return point, bool((np.sign(point) == signs)[taxed].all())

        # close to the end the signs stay: if those of w solve the model, no search is needed
        point, same = solved(np.sign(w))
        out = taxed & (w == 0)
        if same and (np.abs(g + h @ (point - w)) <= self.a)[out].all():
            return point
        v, pull = w.copy(), g.copy()  # pull: the model's slope at v
        diagonal = np.diag(h)
        for _ in range(200):
            moved = 0.0
            for j in np.flatnonzero(diagonal > 0):
                new = _shrink(v[j] - pull[j] / diagonal[j], self.a[j] / diagonal[j])
                if new != v[j]:
                    pull += h[:, j] * (new - v[j])
                    moved = max(moved, abs(new - v[j]))
                    v[j] = new
            if moved < 1e-9 * (1 + np.max(np.abs(v))):
                break
        point, same = solved(np.sign(v))
        return point if same else v


def fit(x: np.ndarray, y: np.ndarray, c: float, l1: float, penalized: np.ndarray | None = None, limit: int = 200, start: Fit | None = None) -> Fit:
    """The certified fit of y (0 and 1) on the columns of x; penalized: which columns are (all, if None).

    start: a fit of the same rows with another penalty, to begin from; the bounds of acceptance are the same.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if x.ndim != 2 or len(x) != len(y) or not np.isfinite(x).all() or set(np.unique(y)) != {0.0, 1.0} or not c > 0 or not 0 <= l1 <= 1:
        raise ValueError("not a two-class problem with finite columns and a valid penalty")
    n, mask = len(y), np.ones(x.shape[1], bool) if penalized is None else np.asarray(penalized, bool)
    for j in np.flatnonzero(~mask):
        by = {v: set(y[x[:, j] == v]) for v in np.unique(x[:, j])}
        if len(by) == 2 and any(len(s) < 2 for s in by.values()):
            raise NotCertified("an unpenalized group has one class: separation")
    middle = x.mean(axis=0)
    weight = np.concatenate(([0.0], mask / (c * n)))
    p = _Problem(x - middle, y, l1 * weight, (1 - l1) * weight)
    w = np.zeros(x.shape[1] + 1)
    w[0] = np.log(y.mean() / (1 - y.mean()))
    if start is not None:
        w[0], w[1:] = start.intercept + middle @ start.coef, start.coef
    free = (p.a == 0) & (p.c == 0)
    steps, value, g = 0, p.value(w), p.slope(w)
    # columns without a penalty are held to their own, closer bound: predictions balance to the last digits
    while steps < limit and not (p.residual(w, g) <= TARGET and np.abs(g[free]).max() <= BALANCE / 4):
        q = _expit(p.x @ w)
        h = (p.x * (q * (1 - q))[:, None]).T @ p.x / n + np.diag(p.c)
        taken = p.along(w, value, g, p.model_minimum(w, g, h) - w)
        if taken is None:
            break
        (w, value), steps = taken, steps + 1
        g = p.slope(w)
    gap, balance = p.gap(w)
    kkt = p.residual(w, p.slope(w))
    if not (kkt <= ACCEPT and -1e-12 <= gap <= GAP and balance <= BALANCE):
        raise NotCertified(f"first-order residual {kkt:.3g}, duality gap {gap:.3g}, balance {balance:.3g}")
    return Fit(float(w[0] - middle @ w[1:]), w[1:].copy(), kkt, gap, value, steps)


def proximal(x: np.ndarray, y: np.ndarray, c: float, l1: float, penalized: np.ndarray | None = None, rounds: int = 20_000) -> Fit:
    """The same objective by another route, an independent check that is never used to choose: the intercept and unpenalized
    columns are minimized out at every point by Newton steps of their own, and the function that is left, of penalized
    coefficients alone, by accelerated proximal gradients from zero."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, mask = len(y), np.ones(x.shape[1], bool) if penalized is None else np.asarray(penalized, bool)
    middle = x.mean(axis=0)
    weight = np.concatenate(([0.0], mask / (c * n)))
    p = _Problem(x - middle, y, l1 * weight, (1 - l1) * weight)
    free, held = np.flatnonzero(weight == 0), np.flatnonzero(weight > 0)

    def settled(w: np.ndarray) -> np.ndarray:
        """w with its free part at the minimum for its penalized part."""
        w = w.copy()
        for _ in range(30):
            q = _expit(p.x @ w)
            off = p.x[:, free].T @ (q - y) / n
            if np.abs(off).max() < 1e-13:
                break
            w[free] -= np.linalg.solve((p.x[:, free] * (q * (1 - q))[:, None]).T @ p.x[:, free] / n, off)
        return w

    rate = 1 / (np.linalg.norm(p.x[:, held], 2) ** 2 / (4 * n) + p.c.max(initial=0.0)) if len(held) else 0.0
    w = last = settled(np.zeros(x.shape[1] + 1))
    t, k = 1.0, 0
    for k in range(rounds):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = w.copy()
        z[held] += (t - 1) / t_next * (w[held] - last[held])
        z = settled(z)
        new = z.copy()
        new[held] = _shrink(z[held] - rate * p.slope(z)[held], rate * p.a[held])
        last, w, t = w, settled(new), t_next
        if (w - last)[held] @ (z - w)[held] > 0:  # overshot: forget the momentum
            t = 1.0
        if k % 10 == 0 and p.residual(w, p.slope(w)) < 1e-10:
            break
    return Fit(float(w[0] - middle @ w[1:]), w[1:].copy(), p.residual(w, p.slope(w)), float("nan"), p.value(w), k)


class Prepared(NamedTuple):
    """What a training part teaches: fills, moments of filled values, and columns with more than one value."""

    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    keep: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((np.where(np.isnan(x), self.fill, x) - self.mean) / self.scale)[:, self.keep]


def prepare(x: np.ndarray, binary: np.ndarray) -> Prepared:
    """Medians (or, for 0/1 columns, modes with ties to 0) fill gaps; numbers are then centred and scaled, divisor n; columns of one value go."""
    if np.isnan(x).all(axis=0).any():
        raise ValueError("a training column is entirely missing")
    ones, seen = np.nansum(x, axis=0), (~np.isnan(x)).sum(axis=0)
    fill = np.where(binary, (ones > seen - ones).astype(float), np.nanmedian(x, axis=0))
    full = np.where(np.isnan(x), fill, x)
    sd = full.std(axis=0)
    keep = np.ptp(full, axis=0) > 0
    if not keep.any():
        raise ValueError("no training column has two values")
    return Prepared(fill, np.where(binary, 0.0, full.mean(axis=0)), np.where(binary | (sd == 0), 1.0, sd), keep)
