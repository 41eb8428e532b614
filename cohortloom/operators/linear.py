"""Least squares with HC3 inference, influence, unpenalized logistic fits and calibration: NumPy kernels of one group."""

from __future__ import annotations

import math

import numpy as np

from cohortloom.functions.distributions import chi2_quantile, chi2_upper, f_upper, t_quantile, t_two_sided


def hc3(a: np.ndarray, v: np.ndarray) -> dict:
    """Coefficients of v on the columns of a, HC3 covariance, t inference, leverage and Cook's distance.

    The sandwich is worked out twice, by QR and by the pseudoinverse; both must agree.
    """
    a, v = np.asarray(a, float), np.asarray(v, float)
    n, p = a.shape
    if not (np.isfinite(a).all() and np.isfinite(v).all()) or n <= p or np.linalg.matrix_rank(a) < p:
        raise ValueError("a finite design of full rank with degrees of freedom left is needed")
    q, r = np.linalg.qr(a)
    back = np.linalg.solve(r, q.T)
    beta = back @ v
    res = v - a @ beta
    lev = np.einsum("ij,ij->i", q, q)
    if lev.max() >= 1 - 1e-8:
        raise ValueError("a leverage is too close to one")
    cov = (back * (res / (1 - lev)) ** 2) @ back.T
    other = np.linalg.pinv(a)
    e2 = v - a @ (other @ v)
    cov2 = (other * (e2 / (1 - np.einsum("ij,ji->i", a, other))) ** 2) @ other.T
    if not (np.allclose(beta, other @ v, rtol=1e-9, atol=1e-10) and np.allclose(cov, cov2, rtol=1e-8, atol=1e-10)):
        raise ArithmeticError("the two solutions differ")
    se, dof = np.sqrt(np.diag(cov)), n - p
    half = t_quantile(0.975, dof) * se
    cooks = res**2 / (p * (res @ res) / dof) * lev / (1 - lev) ** 2
    return {"beta": beta, "se": se, "lo": beta - half, "hi": beta + half, "p": np.array([t_two_sided(b / s, dof) for b, s in zip(beta, se)]), "residuals": res, "leverage": lev, "cooks": cooks, "cov": cov, "dof": dof}


def pooled_sd(v: np.ndarray, y: np.ndarray) -> float:
    """The standard deviation of v within the two groups of y."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return float(np.sqrt(((n1 - 1) * v[y == 1].var(ddof=1) + (n0 - 1) * v[y == 0].var(ddof=1)) / (n1 + n0 - 2)))


def leave_one_out(a: np.ndarray, v: np.ndarray, column: int = 1) -> np.ndarray:
    """The column's coefficient refitted without each row in turn (minimum norm where that lowers the rank)."""
    return np.array([np.linalg.lstsq(np.delete(a, k, 0), np.delete(v, k), rcond=None)[0][column] for k in range(len(v))])


def inflation(a: np.ndarray) -> list[float]:
    """Variance inflation of each column but the first."""
    out = []
    for j in range(1, a.shape[1]):
        rest = np.delete(a, j, 1)
        e = a[:, j] - rest @ np.linalg.lstsq(rest, a[:, j], rcond=None)[0]
        out.append(float(np.sum((a[:, j] - a[:, j].mean()) ** 2) / (e @ e)))
    return out


def influence(a: np.ndarray, v: np.ndarray, sd: float, column: int = 1) -> dict:
    """Refits without each row in turn (minimum norm where that lowers the rank), variance inflation, Cook's distances."""
    full = hc3(a, v)
    loo, vif = leave_one_out(a, v, column) / sd, inflation(a)
    whole = full["beta"][column] / sd
    return {"loo_min": float(loo.min()), "loo_max": float(loo.max()), "sign_changes": int((np.sign(loo) != np.sign(whole)).sum()), "largest_change": int(np.argmax(np.abs(loo - whole))), "vif": vif, "max_cooks": float(full["cooks"].max()), "max_leverage": float(full["leverage"].max()), "cooks_over_4_n": int((full["cooks"] > 4 / len(v)).sum())}


def joint_f(a: np.ndarray, v: np.ndarray, columns: list[int]) -> dict:
    """HC3 F test that the columns' coefficients are all 0, and their partial R squared."""
    f = hc3(a, v)
    b, c = f["beta"][columns], f["cov"][np.ix_(columns, columns)]
    stat = float(b @ np.linalg.solve(c, b) / len(columns))
    rest = np.delete(a, columns, 1)
    r0 = v - rest @ np.linalg.lstsq(rest, v, rcond=None)[0]
    return {"F": stat, "p": f_upper(stat, len(columns), f["dof"]), "partial_r2": float(1 - f["residuals"] @ f["residuals"] / (r0 @ r0))}


def adjusted_means(a: np.ndarray, v: np.ndarray, levels: list[int]) -> dict:
    """For a factor coded by 0/1 columns (reference: all 0): adjusted means with 95 % intervals, and differences of all pairs."""
    f = hc3(a, v)
    crit, at = t_quantile(0.975, f["dof"]), []
    for on in [None, *levels]:
        x = a.copy()
        x[:, levels] = 0
        if on is not None:
            x[:, on] = 1
        at.append(x.mean(axis=0))
    row = lambda d: (float(d @ f["beta"]), crit * float(np.sqrt(d @ f["cov"] @ d)))
    means = [(m, m - h, m + h) for m, h in map(row, at)]
    pairs = {(i, j): (m, m - h, m + h) for i in range(len(at)) for j in range(i) for m, h in [row(at[i] - at[j])]}
    return {"means": means, "differences": pairs}


def _expit(z):
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _nll(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.sum(np.logaddexp(0, np.where(y > 0, -z, z))))


def logistic(x: np.ndarray, y: np.ndarray, offset: np.ndarray | float = 0.0) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, negative log-likelihood, information) of an unpenalized fit; separated or near-singular data are refused."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if np.linalg.matrix_rank(x) < x.shape[1] or len(np.unique(y)) < 2:
        raise ValueError("the design lacks rank or the outcome a class")
    b = np.zeros(x.shape[1])
    value = _nll(x @ b + offset, y)
    for _ in range(100):
        p = _expit(x @ b + offset)
        g, info = x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x
        if np.abs(b).max() > 40 or np.linalg.cond(info) > 1e12:
            raise ValueError("separated, or information too ill-conditioned")
        if np.abs(g).max() < 1e-8:
            return b, value, info
        move, size = np.linalg.solve(info, g), 1.0
        while size > 1e-8 and _nll(x @ (b - size * move) + offset, y) > value + 1e-13:
            size /= 2
        b = b - size * move
        value = _nll(x @ b + offset, y)
    raise ValueError("no convergence")


def separated(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether some direction orders the classes without error: decided by a perceptron-like projection, with the maximum-likelihood fit as witness."""
    try:
        b, _, _ = logistic(x, y)
    except ValueError:
        return True
    side = (x @ b) * (2 * np.asarray(y) - 1)
    return bool((side > 1e-7).all())


def profile_interval(x: np.ndarray, y: np.ndarray, column: int) -> dict:
    """Odds ratio of a column with likelihood-ratio test and 95 % profile-likelihood bounds; separation gives a status instead."""
    if separated(x, y):
        return {"status": "nonestimable_separation", "p": 1.0}
    b, best, _ = logistic(x, y)
    rest = np.delete(x, column, 1)
    lr = max(0.0, 2 * (logistic(rest, y)[1] - best))
    cut = chi2_quantile(0.95, 1)
    over = lambda t: 2 * (logistic(rest, y, x[:, column] * t)[1] - best) - cut
    bounds = []
    for way in (-1, 1):
        far = 0.5
        while over(b[column] + way * far) < 0:
            far *= 2
            if far > 1e4:
                raise ArithmeticError("a profile bound isn't bracketed")
        near = 0.0
        for _ in range(80):
            mid = (near + far) / 2
            near, far = (mid, far) if over(b[column] + way * mid) < 0 else (near, mid)
        bounds.append(b[column] + way * (near + far) / 2)
    return {"status": "estimated", "log_or": float(b[column]), "lo": bounds[0], "hi": bounds[1], "lr": lr, "p": chi2_upper(lr, 1)}


def calibrate(y: np.ndarray, p: np.ndarray, clip: float = 1e-6) -> dict:
    """Calibration intercept (slope 1, by bisection) and joint intercept and slope, with the state of each."""
    y, p = np.asarray(y, float), np.clip(np.asarray(p, float), clip, 1 - clip)
    out = {"status": "NOT_ESTIMABLE_SINGLE_CLASS", "offset": None, "intercept": None, "slope": None}
    if len(np.unique(y)) < 2:
        return out
    z = np.log(p / (1 - p))
    low, high = -50.0, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _expit(z + mid).mean() < y.mean() else (low, mid)
    out["offset"] = (low + high) / 2
    if np.ptp(z) < 1e-10:
        return out | {"status": "CONSTANT_PREDICTIONS_SLOPE_NOT_ESTIMABLE"}
    try:
        b, _, info = logistic(np.column_stack([np.ones(len(z)), z]), y)
    except ValueError:
        return out | {"status": "UNSTABLE_OR_SEPARATED"}
    if np.abs(b).max() >= 50 or np.linalg.cond(info) >= 1e12:
        return out | {"status": "UNSTABLE_OR_SEPARATED"}
    return out | {"status": "ESTIMABLE", "intercept": float(b[0]), "slope": float(b[1])}


def ranks(v: np.ndarray) -> np.ndarray:
    """Average ranks of a vector, or of each column."""
    v = np.asarray(v, float)
    if v.ndim == 2:
        return np.column_stack([ranks(c) for c in v.T])
    values, place, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[place]


def residuals(v: np.ndarray, design: np.ndarray) -> np.ndarray:
    return v - design @ np.linalg.lstsq(design, v, rcond=None)[0]


def partial_spearman(score: np.ndarray, others: np.ndarray, design: np.ndarray) -> np.ndarray:
    """Correlations of the score's ranks with each other column's, less their least-squares fit on a design."""
    r = residuals(ranks(np.column_stack([score, others])), design)
    return np.corrcoef(r.T)[0, 1:]


def rank_auc(y: np.ndarray, p: np.ndarray) -> float:
    y = np.asarray(y)
    a, b = (y == 1).sum(), (y == 0).sum()
    return math.nan if not a or not b else float((ranks(p)[y == 1].sum() - a * (a + 1) / 2) / (a * b))
