"""Time-series diagnostics (survey H1-H5): ACF, PACF, ADF, KPSS, normality.

Shape of every computation: per-series aggregates (partial + final, skew-safe), or maps over
stored pieces of ordered values (:mod:`.pieces`) that send a few numbers per piece to a
per-series step (Levinson-Durbin on <= 21 autocovariances, nested regressions, p-values).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import norm_cdf_col, norm_ppf_col
from ..schema import SEQ, SERIES, VALUE
from .joins import bounded
from .linalg import ols_from_gram
from .order import series_sizes, with_seq
from .pieces import cut, lag_sums, lagged_products, sizes_and_means, with_before


# ---------------------------------------------------------------- H1
def acf(clean: DataFrame | None, nlags: int = 20, min_points: int = 8,
        max_chunk: int | None = None, parts: DataFrame | None = None) -> DataFrame:
    """``(series_id, n, lag, acf, acov_sum)`` for lags 0..min(nlags, n // 2).

    Biased estimator around the global mean: ``acf_k = sum (x_t-m)(x_{t+k}-m) / sum (x_t-m)^2``.
    Series need ``min_points`` points and at least 2 lags.  ``parts``: the pieces, if already cut."""
    parts = cut(clean, max_chunk) if parts is None else parts
    kmax = F.least(F.lit(nlags), F.floor(F.col("n") / 2)).cast("int")
    need = sizes_and_means(parts).withColumn("reach", kmax).where((F.col("n") >= min_points) & (F.col("reach") >= 2))
    need = bounded(need)
    rows = lag_sums(parts, need).join(need.select(SERIES, "n"), SERIES)
    c0 = F.max(F.when(F.col("lag") == 0, F.col("total"))).over(Window.partitionBy(SERIES))  # <= nlags + 1 rows
    return rows.select(SERIES, "n", "lag", F.try_divide(F.col("total"), c0).alias("acf"), F.col("total").alias("acov_sum"))


# ---------------------------------------------------------------- H2
def _levinson_pacf(r: np.ndarray) -> np.ndarray:
    """PACF from autocovariances r_0..r_K by Levinson-Durbin (pacf_0 = 1)."""
    k_max = len(r) - 1
    out = np.full(k_max + 1, np.nan)
    out[0] = 1.0
    if k_max == 0 or r[0] == 0:
        return out
    phi = np.zeros(k_max + 1)
    err = r[0]
    for k in range(1, k_max + 1):
        acc = r[k] - np.dot(phi[1:k], r[1:k][::-1])
        if err <= 0:
            break
        kappa = acc / err
        new = phi.copy()
        new[k] = kappa
        new[1:k] = phi[1:k] - kappa * phi[1:k][::-1]
        phi = new
        err = err * (1.0 - kappa * kappa)
        out[k] = kappa
    return out


def _pacf_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("lag")
    n = float(pdf["n"].iloc[0])
    lags = pdf["lag"].to_numpy()
    # Yule-Walker 'adjusted': r_k = c_k / (n - k), r_0 = c_0 / n
    r = pdf["acov_sum"].to_numpy(dtype=float) / (n - lags)
    vals = _levinson_pacf(r)
    return pd.DataFrame({SERIES: pdf[SERIES].iloc[0], "lag": lags.astype("int32"), "pacf": vals})


def pacf(acf_rows: DataFrame) -> DataFrame:
    """``(series_id, lag, pacf)`` from the ACF rows (<= 21 rows per series)."""
    return acf_rows.select(SERIES, "n", "lag", "acov_sum").groupBy(SERIES).applyInPandas(
        _pacf_group, schema=f"{SERIES} string, lag int, pacf double")


def autocorrelation(clean: DataFrame | None, nlags: int = 20, max_chunk: int | None = None,
                    parts: DataFrame | None = None) -> DataFrame:
    """EDA section: ``(series_id, lag, acf, pacf)``."""
    a = acf(clean, nlags, max_chunk=max_chunk, parts=parts)
    return a.join(pacf(a), [SERIES, "lag"]).select(SERIES, "lag", "acf", "pacf")


# ---------------------------------------------------------------- H4
# KPSS level-stationarity critical values (p = .10, .05, .025, .01).
KPSS_CRIT = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)


def kpss_p_value(stat):
    """Linear interpolation in the critical-value table, clipped to [.01, .10]."""
    c, p = KPSS_CRIT, KPSS_P
    expr = F.when(stat <= c[0], F.lit(p[0]))
    for i in range(len(c) - 1):
        expr = expr.when(stat <= c[i + 1],
                         F.lit(p[i]) + (stat - F.lit(c[i])) * F.lit((p[i + 1] - p[i]) / (c[i + 1] - c[i])))
    return expr.otherwise(F.lit(p[-1]))


def _kpss_pieces(batches):
    """Per piece: what the running sum of deviations adds for any sum before it, and lag products."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            x = np.concatenate([r.ahead, r.ys]) - r.mean
            run = np.cumsum(x[len(r.ahead):])
            out.append([getattr(r, SERIES), r.c, r.n, len(run), run[-1], run.sum(), run @ run,
                        lagged_products(x, len(r.ahead), int(r.reach))])
        yield pd.DataFrame(out, columns=[SERIES, "c", "n", "m", "s", "sp", "spp", "prods"])


def _kpss_series(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum of squared running sums and the automatic bandwidth of one series (a row per piece)."""
    pdf = pdf.sort_values("c")
    before = np.concatenate([[0.0], np.cumsum(pdf["s"])[:-1]])
    eta = float((pdf["m"] * before ** 2 + 2 * before * pdf["sp"] + pdf["spp"]).sum())
    n = int(pdf["n"].iloc[0])
    c = np.sum(np.stack(pdf["prods"]), axis=0)
    k = np.arange(1, len(c))
    s0 = c[0] / n + 2.0 / n * c[1:].sum()
    s1 = 2.0 / n * (k * c[1:]).sum()
    lags = 0  # a constant or infinite series has no bandwidth and, below, no statistic
    if np.isfinite(s0) and s0 != 0:
        lags = int(min(np.floor(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1))
    return pd.DataFrame({SERIES: [pdf[SERIES].iloc[0]], "eta": [eta], "lags": [lags]})


def _long_run(batches):
    """Per piece: its share of the Bartlett-weighted sum of lag products."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            x = np.concatenate([r.ahead, r.ys]) - r.mean
            c = lagged_products(x, len(r.ahead), int(r.reach))
            weight = 2.0 * (1.0 - np.arange(len(c)) / (r.reach + 1.0))
            out.append([getattr(r, SERIES), float(c[0] + weight[1:] @ c[1:])])
        yield pd.DataFrame(out, columns=[SERIES, "s2"])


def kpss_test(clean: DataFrame | None, min_points: int = 8, max_chunk: int | None = None,
              parts: DataFrame | None = None) -> DataFrame:
    """Level KPSS with the automatic (Hobijn et al.) bandwidth.

    Two maps over the pieces: running sums with the lags that choose each series' bandwidth, then the
    weighted sum over that bandwidth.  ``(series_id, n, lags, test_statistic, p_value, crit_10, crit_5,
    crit_2_5, crit_1, is_stationary)``."""
    parts = cut(clean, max_chunk) if parts is None else parts
    facts = bounded(sizes_and_means(parts).where(F.col("n") >= min_points))
    reach = F.floor(F.pow(F.col("n").cast("double"), 2.0 / 9.0)).cast("bigint")
    rows = with_before(parts, facts.select(SERIES, "mean", reach.alias("reach"))).select(SERIES, "c", "n", "ahead", "ys", "mean", "reach")
    per = rows.mapInPandas(_kpss_pieces, f"{SERIES} string, c long, n long, m long, s double, sp double, spp double, prods array<double>")
    chosen = bounded(per.groupBy(SERIES).applyInPandas(_kpss_series, f"{SERIES} string, eta double, lags long"))
    rows = with_before(parts, facts.join(chosen, SERIES).select(SERIES, "mean", F.col("lags").alias("reach"))).select(
        SERIES, "ahead", "ys", "mean", "reach")
    s2 = rows.mapInPandas(_long_run, f"{SERIES} string, s2 double").groupBy(SERIES).agg(F.sum("s2").alias("s2"))
    n = F.col("n").cast("double")
    stat = F.try_divide(F.col("eta") / (n * n), F.col("s2") / n)
    out = facts.join(chosen, SERIES).join(s2, SERIES).select(SERIES, "n", F.col("lags").cast("int").alias("lags"), stat.alias("test_statistic"))
    return out.select(
        "*", kpss_p_value(F.col("test_statistic")).alias("p_value"),
        *[F.lit(c).alias(name) for c, name in zip(KPSS_CRIT, ("crit_10", "crit_5", "crit_2_5", "crit_1"))]
    ).withColumn("is_stationary", F.col("p_value") > 0.05)


# ---------------------------------------------------------------- H5
K2_POINTS = 8  # fewest points of the kurtosis term
SHAPIRO_POINTS = (4, 4999)  # range in which Royston's approximation holds


def dagostino_k2(clean: DataFrame) -> DataFrame:
    """D'Agostino-Pearson K^2 from population skewness / kurtosis (pure SQL arithmetic).
    ``(series_id, n, test_statistic, p_value)``; p = exp(-K^2 / 2) (chi-square, 2 df).
    Series under 8 points, for which the kurtosis term is not defined, are left out."""
    m = clean.groupBy(SERIES).agg(F.count(VALUE).alias("n"), F.skewness(VALUE).alias("g1"),
                                  (F.kurtosis(VALUE) + 3.0).alias("b2")).where(F.col("n") >= K2_POINTS)
    n = F.col("n").cast("double")
    g1, b2 = F.col("g1"), F.col("b2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (beta2 - 1)) - 1.0
    delta = 1.0 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    yy = y / alpha
    z1 = delta * F.log(yy + F.sqrt(yy * yy + 1))
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(var)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2.0 / (9.0 * a)
    denom = 1 + x * F.sqrt(2.0 / (a - 4.0))
    ratio = F.try_divide(1 - 2.0 / a, denom)
    term2 = F.signum(ratio) * F.pow(F.abs(ratio), 1.0 / 3.0)
    z2 = (term1 - term2) / F.sqrt(2.0 / (9.0 * a))
    k2 = z1 * z1 + z2 * z2
    return m.select(SERIES, "n", k2.alias("test_statistic"), F.exp(-k2 / 2.0).alias("p_value"))


def shapiro_wilk(clean: DataFrame, max_chunk: int | None = None) -> DataFrame:
    """Shapiro-Wilk W and p (Royston's approximation), for series with 4 <= n < 5000.

    Order statistics come from skew-safe value ranks; the normal scores ``m_i`` are a column
    expression on them; the rest are grouped sums."""
    base = clean.select(SERIES, VALUE)
    sizes = series_sizes(base)
    small = sizes.where(F.col("n").between(*SHAPIRO_POINTS))
    ranked = with_seq(base.join(small.select(SERIES), SERIES, "left_semi"), order=(VALUE,),
                      seq_col="_r", max_chunk=max_chunk)
    r = ranked.join(small, SERIES).withColumn("_i", F.col("_r") + 1)
    r = r.withColumn("_m", norm_ppf_col((F.col("_i") - 0.375) / (F.col("n") + 0.25)))
    i, n, x, mcol = F.col("_i"), F.col("n"), F.col(VALUE), F.col("_m")
    g = r.groupBy(SERIES, "n").agg(
        F.sum(mcol * mcol).alias("M"), F.sum(mcol * x).alias("S"),
        (F.var_pop(x) * F.count(x)).alias("ss"),
        F.max(F.when(i == n, mcol)).alias("mn"), F.max(F.when(i == n - 1, mcol)).alias("mn1"),
        F.max(F.when(i == 1, x)).alias("x1"), F.max(F.when(i == 2, x)).alias("x2"),
        F.max(F.when(i == n - 1, x)).alias("xn1"), F.max(F.when(i == n, x)).alias("xn"))
    nd = F.col("n").cast("double")
    u = 1.0 / F.sqrt(nd)
    M = F.col("M")
    cn, cn1 = F.col("mn") / F.sqrt(M), F.col("mn1") / F.sqrt(M)
    an = cn + 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5
    an1 = cn1 + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5
    big = F.col("n") > 5
    phi = F.when(big, (M - 2 * F.col("mn") ** 2 - 2 * F.col("mn1") ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)) \
        .otherwise((M - 2 * F.col("mn") ** 2) / (1 - 2 * an ** 2))
    inner_big = F.col("S") - F.col("mn") * (F.col("xn") - F.col("x1")) - F.col("mn1") * (F.col("xn1") - F.col("x2"))
    inner_small = F.col("S") - F.col("mn") * (F.col("xn") - F.col("x1"))
    ax = F.when(big, inner_big / F.sqrt(phi) + an * (F.col("xn") - F.col("x1")) + an1 * (F.col("xn1") - F.col("x2"))) \
        .otherwise(inner_small / F.sqrt(phi) + an * (F.col("xn") - F.col("x1")))
    w = F.when((F.col("ss") > 0) & ~F.isnan("ss"), F.least(F.lit(1.0), F.try_divide(ax * ax, F.col("ss"))))  # constant or infinite: null
    L = F.log(nd)
    small_n = F.col("n") <= 11
    gamma = -2.273 + 0.459 * nd
    z_small = -F.log(gamma - F.log1p(-w))
    mu_small = 0.5440 - 0.39978 * nd + 0.025054 * nd ** 2 - 0.0006714 * nd ** 3
    sd_small = F.exp(1.3822 - 0.77857 * nd + 0.062767 * nd ** 2 - 0.0020322 * nd ** 3)
    z_big = F.log1p(-w)
    mu_big = -1.5861 - 0.31082 * L - 0.083751 * L ** 2 + 0.0038915 * L ** 3
    sd_big = F.exp(-0.4803 - 0.082676 * L + 0.0030302 * L ** 2)
    z = F.when(small_n, (z_small - mu_small) / sd_small).otherwise((z_big - mu_big) / sd_big)
    out = g.select(SERIES, "n", w.alias("test_statistic"), z.alias("_z"))
    return out.select(SERIES, "n", "test_statistic",
                      F.when(F.col("test_statistic") >= 1.0, F.lit(1.0))
                      .otherwise(1.0 - norm_cdf_col(F.col("_z"))).alias("p_value"))


def normality_test(clean: DataFrame, min_points: int = 5, max_chunk: int | None = None,
                   method: str = "k2") -> DataFrame:
    """One normality test for series of every length, normal if p > .05: ``method="k2"``
    (D'Agostino-Pearson) or ``"shapiro"`` (Shapiro-Wilk).

    One row per series of at least ``min_points`` points with a ``status``: ``ok``,
    ``not_applicable`` (a length the test is not defined for) or ``undefined`` (constant or
    infinite values)."""
    if method == "k2":
        found, name, least, most = dagostino_k2(clean), "D'Agostino's K^2", K2_POINTS, None
    elif method == "shapiro":
        found, name, (least, most) = shapiro_wilk(clean, max_chunk), "Shapiro-Wilk", SHAPIRO_POINTS
    else:
        raise ValueError("method must be 'k2' or 'shapiro'")
    n, stat = F.col("n"), F.col("test_statistic")
    sizes = clean.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n")).where(n >= min_points)
    fits = (n >= least) if most is None else n.between(least, most)
    good = stat.isNotNull() & ~F.isnan(stat)
    out = sizes.join(found.drop("n"), SERIES, "left")
    return out.select(
        SERIES, "n", F.lit(name).alias("test_name"),
        F.when(~fits, "not_applicable").when(good, "ok").otherwise("undefined").alias("status"),
        F.when(good, stat).alias("test_statistic"), F.when(good, F.col("p_value")).alias("p_value"),
        F.when(good, F.col("p_value") > 0.05).alias("is_normal"))


# ---------------------------------------------------------------- H3
# MacKinnon (1994) p-value polynomials and MacKinnon (2010) critical-value
# response surfaces for the constant-only Dickey-Fuller regression.
ADF_TAU_MAX, ADF_TAU_MIN, ADF_TAU_STAR = 2.74, -18.83, -1.61
ADF_SMALLP = (2.1659, 1.4412, 0.038269)
ADF_LARGEP = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRIT = {"1%": (-3.43035, -6.5393, -16.786, -79.433),
            "5%": (-2.86154, -2.8903, -4.234, -40.040),
            "10%": (-2.56677, -1.5384, -2.809, 0.0)}


def adf_p_value(tau: float) -> float:
    from ..functions.dist import norm_cdf
    if tau > ADF_TAU_MAX:
        return 1.0
    if tau < ADF_TAU_MIN:
        return 0.0
    coefs = ADF_SMALLP if tau <= ADF_TAU_STAR else ADF_LARGEP
    z = sum(c * tau ** i for i, c in enumerate(coefs))
    return float(norm_cdf(z))


def adf_critical(nobs: int) -> dict[str, float]:
    t = float(nobs)
    return {k: c[0] + c[1] / t + c[2] / t ** 2 + c[3] / t ** 3 for k, c in ADF_CRIT.items()}


def adf_max_lag(n):
    """Column form of ``min(ceil(12 (n/100)^(1/4)), n // 2 - 2)``."""
    return F.least(F.ceil(F.lit(12.0) * F.pow(F.col(n).cast("double") / 100.0, 0.25)),
                   F.floor(F.col(n) / 2) - 2).cast("int")


def _adf_pieces(batches):
    """Per piece, over t > K: lag products of the differences, their products with the level before,
    sums of that level, and the values near either end of the series (around the mean)."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            k, h, base = int(r.maxlag), len(r.ahead), int(r.lo) - len(r.ahead)
            y = np.concatenate([r.ahead, r.ys]) - r.mean
            first = max(int(r.lo), k + 1) - base  # place of the first t
            dif, level = np.diff(y), y[first - 1:-1]  # dif[j] = y[j + 1] - y[j]
            target = dif[first - 1:]
            took = len(target)
            dd = [target @ dif[first - 1 - j:first - 1 - j + took] for j in range(k + 1)] if took else [0.0] * (k + 1)
            ld = [level @ dif[first - 1 - j:first - 1 - j + took] for j in range(k + 1)] if took else [0.0] * (k + 1)
            own = y[h:]
            out.append([getattr(r, SERIES), r.c, r.n, k, dd, ld, float(level.sum()), float(level @ level),
                        own[:max(0, k + 2 - int(r.lo))], own[max(0, int(r.n) - k - 2 - int(r.lo)):]])
        yield pd.DataFrame(out, columns=[SERIES, "c", "n", "maxlag", "dd", "ld", "l", "ll", "head", "tail"])


def _adf_gram(dd, ld, l, ll, head, tail, n: int, k: int, lag: int):
    """Cross products of [1, level, d_1 .. d_lag | d_0] over t > lag, from the sums over t > k.

    Rows t = lag + 1 .. k come from the first values; d_i d_j follows from d_{i-1} d_{j-1} by what the
    shifted sum gains at the start and loses at the end."""
    dd, ld = dd[:lag + 1].copy(), ld[:lag + 1].copy()
    first, last = np.diff(head), np.diff(tail)  # first[j] = d at t = j + 1; last[-1] = d at t = n - 1
    for t in range(lag + 1, k + 1):
        back = first[t - 1 - np.arange(lag + 1)]
        dd += first[t - 1] * back
        ld += head[t - 1] * back
        l += head[t - 1]
        ll += head[t - 1] ** 2
    nobs = n - 1 - lag
    g = np.zeros((lag + 3, lag + 3))
    d = np.zeros((lag + 1, lag + 1))
    d[0] = dd
    start, end = first[lag - 1 - np.arange(lag)] if lag else np.zeros(0), last[-1 - np.arange(lag)] if lag else np.zeros(0)
    for i in range(1, lag + 1):
        d[i, i:] = d[i - 1, i - 1:lag] + start[i - 1] * start[i - 1:] - end[i - 1] * end[i - 1:]
    sums = np.array([tail[-1 - j] - head[lag - j] for j in range(lag + 1)])
    order = [*range(1, lag + 1), 0]
    g[0, 0], g[0, 1], g[1, 1] = nobs, l, ll
    g[0, 2:], g[1, 2:] = sums[order], ld[order]
    g[2:, 2:] = (d + np.triu(d, 1).T)[np.ix_(order, order)]
    return np.triu(g) + np.triu(g, 1).T


def _adf_series(pdf: pd.DataFrame) -> pd.DataFrame:
    """Lag by AIC on the common sample (all nested fits from one factorisation), then the test."""
    pdf = pdf.sort_values("c")
    n, k = int(pdf["n"].iloc[0]), int(pdf["maxlag"].iloc[0])
    dd, ld = (np.sum(np.stack(pdf[x]), axis=0) for x in ("dd", "ld"))
    sums = dd, ld, float(pdf["l"].sum()), float(pdf["ll"].sum()), np.concatenate(list(pdf["head"])), np.concatenate(list(pdf["tail"]))
    lag, tau = 0, np.nan
    if np.isfinite(dd).all() and np.isfinite(ld).all():
        g = _adf_gram(*sums, n, k, k)
        nobs = n - 1 - k
        ssr = _nested_ssr(g)[2:]
        with np.errstate(divide="ignore"):
            aic = nobs * (np.log(2 * np.pi) + np.log(np.maximum(ssr, 0.0) / nobs) + 1.0) + 2.0 * (2 + np.arange(k + 1))
        lag = int(np.argmin(aic))
        g = _adf_gram(*sums, n, k, lag)
        idx = [1, *range(2, 2 + lag), 0]
        beta, ssr, xtx = ols_from_gram(g, idx)
        dof = n - 1 - lag - len(idx)
        try:
            tau = float(beta[0] / np.sqrt((ssr / dof if dof > 0 else np.nan) * np.linalg.inv(xtx)[0, 0]))
        except np.linalg.LinAlgError:
            tau = np.nan
    nobs = n - 1 - lag
    crit = adf_critical(nobs)
    return pd.DataFrame({SERIES: [pdf[SERIES].iloc[0]], "n": [n], "used_lag": [lag], "nobs": [nobs], "test_statistic": [tau],
                         "p_value": [adf_p_value(tau) if np.isfinite(tau) else np.nan],
                         **{f"crit_{c[:-1]}": [v] for c, v in crit.items()}})


def _nested_ssr(g: np.ndarray) -> np.ndarray:
    """Residual sums of squares of the last column on the first 0, 1, 2, ... others."""
    k = len(g) - 1
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    scaled = g / np.outer(scale, scale)
    try:
        z = np.linalg.solve(np.linalg.cholesky(scaled[:k, :k]), scaled[:k, k])
        return g[k, k] * (1.0 - np.concatenate([[0.0], np.cumsum(z * z)]))
    except np.linalg.LinAlgError:  # columns that depend on each other
        return np.array([g[k, k], *(ols_from_gram(g, list(range(m)))[1] for m in range(1, k + 1))])


def adf_test(clean: DataFrame | None, min_points: int = 8, max_chunk: int | None = None,
             max_lag: int | None = None, parts: DataFrame | None = None) -> DataFrame:
    """Augmented Dickey-Fuller (constant, lag length by AIC over 0..maxlag; ``max_lag`` lowers it).

    Regression of dy_t on [1, y_{t-1}, dy_{t-1..t-k}].  One map over the pieces gives O(K) numbers per
    piece, K being the series' own lag bound; the cross products of all lags follow from them by the
    shift structure, on the common sample and on the chosen lag's own.  ``(series_id, n, used_lag,
    nobs, test_statistic, p_value, crit_1, crit_5, crit_10, is_stationary)``."""
    parts = cut(clean, max_chunk) if parts is None else parts
    lag = adf_max_lag("n") if max_lag is None else F.least(adf_max_lag("n"), F.lit(max_lag))
    need = sizes_and_means(parts).where(F.col("n") >= max(min_points, 8)).withColumn("maxlag", lag).where("maxlag >= 0")
    rows = with_before(parts, need.select(SERIES, "mean", "maxlag", (F.col("maxlag") + 1).cast("long").alias("reach")))
    per = rows.select(SERIES, "c", "lo", "n", "ahead", "ys", "mean", "maxlag").mapInPandas(
        _adf_pieces, f"{SERIES} string, c long, n long, maxlag int, dd array<double>, ld array<double>, l double, ll double, "
                     "head array<double>, tail array<double>")
    res = per.groupBy(SERIES).applyInPandas(
        _adf_series, f"{SERIES} string, n long, used_lag int, nobs long, test_statistic double, p_value double, "
                     "crit_1 double, crit_5 double, crit_10 double")
    return res.withColumn("is_stationary", F.col("p_value") < 0.05)


def stationarity_tests(clean: DataFrame | None, max_chunk: int | None = None, parts: DataFrame | None = None) -> DataFrame:
    """EDA section: ADF and KPSS side by side (series with >= 8 points)."""
    parts = cut(clean, max_chunk) if parts is None else parts
    a = adf_test(None, parts=parts).select(
        SERIES, F.col("test_statistic").alias("adf_statistic"), F.col("p_value").alias("adf_p_value"),
        F.col("crit_1").alias("adf_crit_1"), F.col("crit_5").alias("adf_crit_5"),
        F.col("crit_10").alias("adf_crit_10"), F.col("is_stationary").alias("adf_is_stationary"))
    k = kpss_test(None, parts=parts).select(
        SERIES, F.col("test_statistic").alias("kpss_statistic"), F.col("p_value").alias("kpss_p_value"),
        F.col("lags").alias("kpss_lags"), F.col("is_stationary").alias("kpss_is_stationary"))
    return a.join(k, SERIES, "full")
