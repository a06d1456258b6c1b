"""Conditional least squares for (seasonal) ARMA models over pieces of a series.

With f = phi(B) (1-B)^d (1-B^m)^D and b = theta(B) the residuals obey

    u_t = f(B) y_t - c,        e_t = u_t - sum_l b_l e_{t-l}

and their derivatives obey the same recursion with other inputs.  All of it is affine in the state
at the start of a piece (the last residuals and the last derivatives), so a piece of consecutive
points is summarised exactly, for unknown incoming state, by

* ``basis``: residuals and derivatives from a zero state, the responses G to unit residuals before
  the piece, and the responses' derivatives K;
* ``gram``: the cross products of the basis, from which e'e, J'e and J'J follow for any state;
* ``tail``: the basis at the last points, which carries the state to the next piece.

:func:`compose` walks the summaries of a series in order.  The result does not depend on where the
series is cut: there is no warm-up, and one piece or a thousand give the same sums.

:func:`advance` is one Levenberg-Marquardt decision on such sums, so the same code drives a fit in
one task (short series) and a fit whose every evaluation is a Spark job (long ones).
"""

from __future__ import annotations

import numpy as np

#: Evaluations after which a fit that has not settled is reported as "not converged".
MAX_EVALUATIONS = 100
#: Relative gain in the sum of squares below which a fit has settled.
SETTLED = 1e-9
#: Roots of the moving average stay below this; beyond 1 residuals would grow without bound.
BORDER = 0.9999


class Spec:
    """Polynomial structure: which parameters multiply which lags."""

    def __init__(self, p: int = 0, q: int = 0, P: int = 0, Q: int = 0, m: int = 0, const: bool = False,
                 d: int = 0, D: int = 0):
        self.p, self.q, self.P, self.Q, self.m, self.const, self.d, self.D = p, q, P, Q, m, const, d, D
        self.k = p + q + P + Q + int(const)
        self.ma_at = [*range(p, p + q), *range(p + q + P, p + q + P + Q)]
        self.diff = np.array([1.0])
        for step in [1] * d + [m] * D:
            self.diff = np.convolve(self.diff, _unit(step, -1.0) + _unit(0, 1.0, step))
        #: points before the first residual; residuals a residual looks back on
        self.reach = p + P * m + len(self.diff) - 1
        self.r = q + Q * m

    def split(self, theta):
        cut = np.cumsum([self.p, self.q, self.P, self.Q])
        ar, ma, sar, sma, rest = np.split(np.asarray(theta, float), cut)
        return ar, ma, sar, sma, rest[0] if self.const else 0.0

    def factors(self, theta):
        """(ar, seasonal ar, ma, seasonal ma) as polynomials in B."""
        ar, ma, sar, sma, _ = self.split(theta)
        return np.r_[1.0, -ar], _spread(-sar, self.m), np.r_[1.0, ma], _spread(sma, self.m)

    def polys(self, theta):
        """phi(B), theta(B) as coefficient arrays, and the constant."""
        a, s, b, t = self.factors(theta)
        return np.convolve(a, s), np.convolve(b, t), self.split(theta)[4]

    def slopes(self, theta):
        """Derivatives of phi(B) (differenced) and of theta(B) by each parameter; None where 0."""
        a, s, b, t = self.factors(theta)
        ar = [np.convolve(np.convolve(_unit(i, -1.0, self.p), s), self.diff) for i in range(1, self.p + 1)]
        sar = [np.convolve(np.convolve(a, _unit(j * self.m, -1.0, self.P * self.m)), self.diff) for j in range(1, self.P + 1)]
        ma = [np.convolve(_unit(i, 1.0, self.q), t) for i in range(1, self.q + 1)]
        sma = [np.convolve(b, _unit(j * self.m, 1.0, self.Q * self.m)) for j in range(1, self.Q + 1)]
        n = [None]
        return ar + n * self.q + sar + n * self.Q + n * self.const, n * self.p + ma + n * self.P + sma + n * self.const


def _unit(at: int, value: float, size: int | None = None) -> np.ndarray:
    out = np.zeros((at if size is None else size) + 1)
    out[at] = value
    return out


def _spread(coef: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros(len(coef) * m + 1)
    out[0] = 1.0
    for j, v in enumerate(coef, start=1):
        out[j * m] = v
    return out


def recur(x: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
    """y_t = x_t - sum_{l>=1} b_l y_{t-l} down the rows of ``x``; ``before`` holds the rows of y ahead
    of it, the latest last.

    Rows are cut into about sqrt(n) blocks that run side by side from a zero state; each block's
    true state then follows from the one before it, and its response is added."""
    n, cols = x.shape
    r = len(b) - 1
    if r == 0 or n == 0:
        return x.copy()
    size = max(r, int(np.sqrt(n)))
    blocks = -(-n // size)
    y = np.zeros((blocks * size, cols))
    y[:n] = x
    y = np.ascontiguousarray(y.reshape(blocks, size, cols).transpose(1, 0, 2))
    unit = np.zeros((r + size, r))
    unit[:r] = np.eye(r)
    for t in range(size):
        for lag in range(1, r + 1):
            if b[lag]:
                if t >= lag:
                    y[t] -= b[lag] * y[t - lag]
                unit[r + t] -= b[lag] * unit[r + t - lag]
    unit = unit[r:]
    state = np.zeros((blocks, r, cols))
    state[0] = before
    for j in range(1, blocks):
        state[j] = y[size - r:, j - 1] + unit[size - r:] @ state[j - 1]
    y += np.einsum("tr,jrc->tjc", unit, state)
    return y.transpose(1, 0, 2).reshape(blocks * size, cols)[:n]


def apply_poly(poly: np.ndarray, ahead: np.ndarray, x: np.ndarray) -> np.ndarray:
    """sum_l poly_l x_{t-l} for the rows of ``x``; ``ahead``: the rows before it."""
    full = np.concatenate([ahead, x])
    k, n = len(ahead), len(x)
    out = np.zeros(x.shape)
    for lag, v in enumerate(poly):
        if v and lag <= k + n:
            lo = max(0, lag - k)
            out[lo:] += v * full[k + lo - lag:k + n - lag]
    return out


def piece_basis(y: np.ndarray, first: int, spec: Spec, theta) -> np.ndarray:
    """Basis columns [e0 | d0 | G | K] at the points ``first`` .. of ``y`` (``first`` >= spec.reach)."""
    phi, b, c = spec.polys(theta)
    by_ar, by_ma = spec.slopes(theta)
    n, r, k = len(y) - first, spec.r, spec.k

    def lagged(poly):
        out = np.zeros(n)
        for lag, v in enumerate(poly):
            if v:
                out += v * y[first - lag:len(y) - lag]
        return out

    f = np.convolve(phi, spec.diff)
    x = np.zeros((n, 1 + k + r))
    x[:, 0] = lagged(f) - c
    for i, poly in enumerate(by_ar):
        if poly is not None:
            x[:, 1 + i] = lagged(poly)
    if spec.const:
        x[:, k] = -1.0
    before = np.zeros((r, 1 + k + r))
    before[:, 1 + k:] = np.eye(r)
    z = recur(x, b, before)
    if not r:
        return z
    # a moving-average parameter enters through the residuals before: those from zero, and G's
    own = np.concatenate([z[:, :1], z[:, 1 + k:]], axis=1)
    ahead = np.concatenate([np.zeros((r, 1)), np.eye(r)], axis=1)
    extra = [recur(-apply_poly(by_ma[i], ahead, own), b, np.zeros((r, 1 + r))) for i in spec.ma_at]
    for i, e in zip(spec.ma_at, extra):
        z[:, 1 + i] = e[:, 0]
    return np.concatenate([z] + [e[:, 1:] for e in extra], axis=1)


def summary(y: np.ndarray, first: int, spec: Spec, theta) -> tuple[int, np.ndarray, np.ndarray]:
    """(points, gram, tail) of a piece: the points ``first`` .. of ``y``, with enough before them."""
    with np.errstate(over="ignore", invalid="ignore"):
        z = piece_basis(y, first, spec, theta)
        r, width = spec.r, z.shape[1]
        # a piece shorter than the state keeps the later rows of the incoming one
        tail = np.zeros((r, width))
        if r:
            whole = np.concatenate([np.zeros((r, width)), z])
            whole[:r, 1 + spec.k:1 + spec.k + r] = np.eye(r)
            tail = whole[len(whole) - r:]
        return len(z), z.T @ z, tail


def _weights(spec: Spec, s: np.ndarray, deltas: np.ndarray) -> np.ndarray:
    """Rows e, d_1 .. d_k as combinations of the basis, for incoming residuals and derivatives."""
    k, r = spec.k, spec.r
    w = np.zeros((1 + k, 1 + k + r * (1 + len(spec.ma_at))))
    w[:, :1 + k] = np.eye(1 + k)
    if r:
        w[0, 1 + k:1 + k + r] = s
        w[1:, 1 + k:1 + k + r] = deltas
        for j, i in enumerate(spec.ma_at):
            at = 1 + k + r * (1 + j)
            w[1 + i, at:at + r] = s
    return w


def compose(pieces, spec: Spec):
    """(sse, J'e, J'J, points, last residuals, residuals before each piece) over ordered summaries."""
    s, deltas = np.zeros(spec.r), np.zeros((spec.k, spec.r))
    total, points, entries = np.zeros((1 + spec.k,) * 2), 0, []
    with np.errstate(over="ignore", invalid="ignore"):
        for n, gram, tail in pieces:
            entries.append(s)
            w = _weights(spec, s, deltas)
            total += w @ gram @ w.T
            state = w @ tail.T
            s, deltas, points = state[0], state[1:], points + n
    return float(total[0, 0]), total[0, 1:], total[1:, 1:], points, s, entries


# ---- fitting -----------------------------------------------------------------------------------

def start(spec: Spec) -> dict:
    """A fit before its first evaluation (at zero; the regression on lags follows from it)."""
    return {"trial": [0.0] * spec.k, "best": None, "sse": None, "nobs": 0, "lam": 1e-3, "phase": 0, "evals": 0,
            "status": "open", "jtj": None, "jte": None, "tail": []}


def _solve(jtj: np.ndarray, jte: np.ndarray, lam: float) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.diag(jtj), 1e-300))
    a = jtj / np.outer(scale, scale) + lam * np.eye(len(scale))
    return -np.linalg.lstsq(a, jte / scale, rcond=None)[0] / scale


def advance(fit: dict, spec: Spec, sums) -> dict:
    """One decision on the evaluation of ``fit["trial"]``: keep or drop it, and where to go next.

    Without moving-average terms the first step is the regression itself.  With them it gives the
    autoregressive start, and damped steps follow until the gain is below ``SETTLED``."""
    sse, jte, jtj, nobs, tail, _ = sums
    fit = dict(fit, evals=fit["evals"] + 1)
    finite = np.isfinite(sse) and np.isfinite(jtj).all() and np.isfinite(jte).all()
    if nobs <= spec.k:
        return fit | {"status": "failed: too few points", "nobs": nobs}
    if fit["phase"] == 0:
        if not finite:
            return fit | {"status": "failed: values are not finite", "nobs": nobs}
        if spec.k == 0:
            return fit | {"best": [], "sse": sse, "nobs": nobs, "status": "ok", "tail": tail.tolist()}
        linear = [i for i in range(spec.k) if i not in spec.ma_at]
        theta = np.zeros(spec.k)
        theta[linear] = _solve(jtj[np.ix_(linear, linear)], jte[linear], 0.0)
        theta[spec.ma_at] = 0.1 if spec.q or spec.Q else 0.0
        return fit | {"trial": theta.tolist(), "phase": 1}
    better = finite and (fit["sse"] is None or sse < fit["sse"])
    gain = np.inf if fit["sse"] is None else (fit["sse"] - sse) / max(fit["sse"], 1e-300) if finite else -np.inf
    if better:
        lam = fit["lam"] if fit["sse"] is None else max(fit["lam"] / 3, 1e-12)
        fit |= {"best": fit["trial"], "sse": sse, "nobs": nobs, "lam": lam, "jtj": jtj.tolist(), "jte": jte.tolist(), "tail": tail.tolist()}
        if not spec.ma_at or sse == 0 or gain < SETTLED:
            return fit | {"status": "ok"}
    elif fit["best"] is None:
        # the start itself is out of range: try nearer to zero
        if fit["evals"] > 40:
            return fit | {"status": "failed: no finite start", "nobs": nobs}
        return fit | {"trial": (0.5 * np.asarray(fit["trial"])).tolist()}
    else:
        if abs(gain) < SETTLED or fit["lam"] > 1e10:
            return fit | {"status": "ok"}
        fit |= {"lam": fit["lam"] * 10}
    if fit["evals"] >= MAX_EVALUATIONS:
        return fit | {"status": "not converged"}
    best, jtj, jte = (np.asarray(fit[x]) for x in ("best", "jtj", "jte"))
    trial = best + _solve(jtj, jte, fit["lam"])
    while not invertible(spec, trial) and fit["lam"] < 1e10:  # no need to look at the data for that
        fit["lam"] *= 10
        trial = best + _solve(jtj, jte, fit["lam"])
    return fit | {"trial": trial.tolist()}


def invertible(spec: Spec, theta) -> bool:
    """Whether the moving-average factors have all their roots inside the border."""
    _, ma, _, sma, _ = spec.split(theta)
    return all(np.all(np.abs(np.roots(np.r_[1.0, x])) < BORDER) for x in (ma, sma) if np.isfinite(x).all())


def fit_whole(y: np.ndarray, spec: Spec, fit: dict | None = None) -> dict:
    """The fit of a series that is one piece."""
    fit = fit or start(spec)
    if len(y) <= spec.reach:
        return fit | {"status": "failed: too few points"}
    while fit["status"] == "open":
        fit = advance(fit, spec, compose([summary(y, spec.reach, spec, fit["trial"])], spec))
    return fit


# ---- forecasts ---------------------------------------------------------------------------------

def head(spec: Spec, theta, y_tail: np.ndarray, e_tail: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` forecasts after ``y_tail`` (at least ``spec.reach`` values) and ``e_tail``."""
    phi, b, c = spec.polys(theta)
    f = np.convolve(phi, spec.diff)
    ys, es = list(y_tail), list(e_tail)
    for step in range(count):
        ar = sum(f[lag] * ys[-lag] for lag in range(1, len(f)) if f[lag])
        ma = sum(b[lag] * es[len(es) - lag] for lag in range(step + 1, len(b)) if b[lag]) if step < len(b) - 1 else 0.0
        ys.append(c - ar + ma)
        es.append(0.0)
    return np.array(ys[len(y_tail):])


def path(spec: Spec, theta, y_tail, e_tail, lo: int, count: int) -> np.ndarray:
    """Forecasts of the steps ``lo`` + 1 .. ``lo`` + ``count`` without those between: past the reach of
    the residuals the recursion is a matrix, and its power jumps ahead."""
    y_tail = np.asarray(y_tail, float)
    first = head(spec, theta, y_tail, np.asarray(e_tail, float), spec.r)
    out = first[lo:lo + count]
    if len(out) == count:
        return out
    phi, _, c = spec.polys(theta)
    f = np.convolve(phi, spec.diff)
    reach = len(f) - 1
    skip = max(lo - spec.r, 0)
    x = np.full((count - len(out), 1), c)
    if reach == 0:
        return np.r_[out, x[:, 0]]
    hist = np.r_[y_tail, first][-reach:]
    if skip:  # state (latest last, then 1) -> the next one
        a = np.zeros((reach + 1, reach + 1))
        a[:reach - 1, 1:reach] = np.eye(reach - 1)
        a[reach - 1, :reach] = -f[:0:-1]
        a[reach - 1, reach] = c
        a[reach, reach] = 1.0
        hist = (np.linalg.matrix_power(a, skip) @ np.r_[hist, 1.0])[:reach]
    return np.r_[out, recur(x, f, hist[:, None])[:, 0]]


def spread(spec: Spec, theta, sigma2: float, steps: int) -> np.ndarray:
    """Standard errors of the forecasts from the psi weights of the whole model."""
    phi, b, _ = spec.polys(theta)
    f = np.convolve(phi, spec.diff)
    psi = np.zeros(steps)
    for j in range(steps):
        psi[j] = (b[j] if j < len(b) else 0.0) - sum(f[i] * psi[j - i] for i in range(1, min(j, len(f) - 1) + 1) if f[i])
    return np.sqrt(sigma2 * np.cumsum(psi ** 2))


def aic_of(sse: float, nobs: int, k: int) -> float:
    if nobs <= 0 or sse <= 0:
        return float("-inf") if nobs > 0 else float("inf")
    return nobs * (np.log(2 * np.pi * sse / nobs) + 1.0) + 2.0 * (k + 1)
