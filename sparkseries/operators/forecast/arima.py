"""ARIMA and seasonal ARIMA by conditional least squares, at every length (survey F4, F5, F12).

Same model family as an exact-likelihood ARIMA, different estimator (pre-sample residuals 0,
conditioning on the first points).  One path for all lengths:

* ``d`` per series from the distributed ADF test (p < .05 -> d = 0, else 1); every order p, q in
  0..2 is fitted on the first 80 %, the least AIC wins, the winner is refitted on all points;
* :func:`pieces` cuts every series into runs of ``chunkRows`` points, each with the few points that
  its differences and lags reach back to, written once;
* a fit evaluates the sum of squares and its derivatives from exact piece summaries
  (:mod:`.css`): one job over the pieces evaluates all orders of all long series at once, the
  summaries (a few hundred numbers a piece) meet by series, and one Levenberg-Marquardt decision
  per order follows.  A series of one piece does the same evaluations inside its task, with the
  same functions, so the cut decides where the work runs and nothing else;
* hold-out metrics compare the multi-step forecast of the last 20 % piece by piece: a piece jumps
  to its first step by a matrix power.  ``mode="in_sample"`` gives one-step errors of the refitted
  model over the same points instead (residuals from the exact state before each piece).

Every fit carries a status: ``ok``, ``not converged`` (after ``css.MAX_EVALUATIONS``) or ``failed: ...``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...schema import SEQ, SERIES, VALUE
from ...session import stored
from ..diagnostics import adf_test
from ..joins import bounded
from ..order import CHUNK, CORE, chunk_rows, halo_frame
from . import css
from .common import Prepared, mean_errors, spread_interval, steps_for

MAX_ORDER = 2
TRAIN_SHARE = 0.8
#: Points a piece holds at most; a task keeps a few dozen numbers for each while it evaluates.
PIECE_ROWS = 1 << 17
ORDER_COLS = ("p", "d", "q", "sp", "sd", "sq", "m")  # sp/sd/sq: seasonal P, D, Q
FIT_SCHEMA = (f"{SERIES} string, " + ", ".join(f"{c} int" for c in ORDER_COLS)
              + ", train boolean, params array<double>, sse double, nobs long, aic double, evals int, "
                "e_tail array<double>, status string")
SEASONAL = dict(p=1, d=1, q=1, sp=1, sd=1, sq=1, m=12)


def _kept(df: DataFrame) -> DataFrame:
    return stored(df, "arima")


def spec_of(order) -> css.Spec:
    p, d, q, P, D, Q, m = (int(order[c]) for c in ORDER_COLS)
    return css.Spec(p=p, q=q, P=P, Q=Q, m=m, const=(d == 0 and D == 0), d=d, D=D)


def train_points(n):
    return F.floor(F.col(n) * TRAIN_SHARE).cast("long")


# ---------------------------------------------------------------- pieces
def pieces(prep: Prepared, facts: DataFrame, reach: int, size: int | None = None) -> DataFrame:
    """``(series_id, c, base, lo, n, n_train, ys)``: the points from ``lo`` on, at most ``size``, with up
    to ``reach`` points before them; ``ys`` begins at position ``base``."""
    size = size or prep.max_chunk or min(chunk_rows(prep.clean), PIECE_ROWS)
    data = prep.clean.join(facts.select(SERIES, "n"), SERIES).select(SERIES, SEQ, VALUE, "n")
    rows = halo_frame(data, back=reach, max_chunk=max(size, reach + 1)).groupBy(SERIES, CHUNK).agg(
        F.max("n").alias("n"), F.min(F.when(F.col(CORE), F.col(SEQ))).alias("lo"),
        F.sort_array(F.collect_list(F.struct(SEQ, VALUE))).alias("ys"))
    # a chunk of copied points alone holds nothing of its own
    rows = rows.where("lo is not null").select(
        SERIES, F.col(CHUNK).cast("long").alias("c"), F.element_at("ys", 1)[SEQ].alias("base"), "lo", "n",
        train_points("n").alias("n_train"), F.transform("ys", lambda x: x[VALUE]).alias("ys"))
    return _kept(rows)


def last_values(parts: DataFrame, cut: str, reach: int) -> DataFrame:
    """``(series_id, y_tail)``: the ``reach`` values before position ``cut`` (a column), or all if fewer."""
    end = (F.col(cut) - F.col("base")).cast("int")
    begin = F.greatest(end - reach, F.lit(0))
    holds = (F.col("lo") < F.col(cut)) & (F.col(cut) <= F.col("base") + F.size("ys"))
    return parts.where(holds).select(SERIES, F.slice("ys", begin + 1, F.greatest(end - begin, F.lit(0))).alias("y_tail"))


def _cut(r, spec: css.Spec, train: bool):
    """(points, place of the first residual) of one piece for a fit on the training part or on all."""
    y = np.asarray(r.ys, float)[:max(0, (r.n_train if train else r.n) - r.base)]
    return y, max(r.lo, spec.reach) - r.base


# ---------------------------------------------------------------- fits
def _plan(orders: DataFrame, train: bool, params=None) -> DataFrame:
    """``(series_id, plan)`` from ``(series_id, p, d, q, ...)`` rows: the fits of a series as JSON."""
    one = F.struct(*[F.col(c).cast("int").alias(c) for c in ORDER_COLS], F.lit(train).alias("train"),
                   (F.lit(None).cast("array<double>") if params is None else F.col(params)).alias("from"))
    return orders.groupBy(SERIES).agg(F.to_json(F.sort_array(F.collect_list(one)), {"ignoreNullFields": "false"}).alias("plan"))


def _open(plan: str) -> list[dict]:
    out = json.loads(plan)
    for x in out:
        if "fit" not in x:
            x["fit"] = css.start(spec_of(x))
            if x.get("from") is not None:  # a known estimate nearby: no regression start
                x["fit"] |= {"trial": x["from"], "phase": 1}
    return out


def _fit_rows(sid: str, plan: list[dict]) -> pd.DataFrame:
    rows = []
    for x in plan:
        f, k = x["fit"], spec_of(x).k
        done = f["best"] is not None
        aic = css.aic_of(f["sse"], f["nobs"], k) if done else np.inf
        status = f["status"] if not done or np.isfinite(aic) or f["status"] != "ok" else "failed: no residual variance"
        rows.append([sid, *(x[c] for c in ORDER_COLS), x["train"], f["best"] if done else [np.nan] * k,
                     f["sse"] if done else np.nan, f["nobs"], float(aic), f["evals"], f["tail"], status])
    return pd.DataFrame(rows, columns=[SERIES, *ORDER_COLS, "train", "params", "sse", "nobs", "aic", "evals", "e_tail", "status"])


def _fit_in_task(batches):
    for pdf in batches:
        for r in pdf.itertuples():
            plan = _open(r.plan)
            for x in plan:
                spec = spec_of(x)
                x["fit"] = css.fit_whole(_cut(r, spec, x["train"])[0], spec, x["fit"])
            yield _fit_rows(getattr(r, SERIES), plan)


SUMS_SCHEMA = f"{SERIES} string, c long, no int, points long, gram array<double>, tail array<double>"


def _sums(batches):
    """Summaries of one piece for every fit of its series that is not settled."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            for no, x in enumerate(_open(r.plan)):
                spec = spec_of(x)
                y, first = _cut(r, spec, x["train"])
                theta = x["fit"]["trial"] if x["fit"]["status"] == "open" else x["fit"]["best"] if r.all_fits else None
                if theta is not None and first < len(y):
                    n, gram, tail = css.summary(y, first, spec, theta)
                    out.append([getattr(r, SERIES), r.c, no, n, gram.ravel(), tail.ravel()])
        yield pd.DataFrame(out, columns=[SERIES, "c", "no", "points", "gram", "tail"])


def _ordered(sums: pd.DataFrame, no: int, spec: css.Spec):
    own = sums[sums["no"] == no].sort_values("c")
    for n, gram, tail in zip(own["points"], own["gram"], own["tail"]):
        gram = np.asarray(gram, float)
        width = int(np.sqrt(len(gram)))
        yield int(n), gram.reshape(width, width), np.asarray(tail, float).reshape(spec.r, width)


STATE_SCHEMA = f"{SERIES} string, plan string, unsettled int"


def _decide(sums: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """One decision for every unsettled fit of a series (cogrouped: its summaries, its plan)."""
    plan = _open(state["plan"].iloc[0])
    for no, x in enumerate(plan):
        if x["fit"]["status"] == "open":
            spec = spec_of(x)
            x["fit"] = css.advance(x["fit"], spec, css.compose(_ordered(sums, no, spec), spec))
    return pd.DataFrame({SERIES: [state[SERIES].iloc[0]], "plan": [json.dumps(plan)],
                         "unsettled": [sum(x["fit"]["status"] == "open" for x in plan)]})


def _settled(batches):
    for pdf in batches:
        for r in pdf.itertuples():
            yield _fit_rows(getattr(r, SERIES), _open(r.plan))


def fit_orders(parts: DataFrame, plan: DataFrame) -> DataFrame:
    """Fit every order of ``plan(series_id, plan)`` over the pieces ``parts``: rows of ``FIT_SCHEMA``."""
    plan = bounded(plan, keep=_kept)
    one = parts.withColumn("_parts", F.lit(1))
    counts = bounded(one.groupBy(SERIES).agg(F.count(F.lit(1)).alias("_pieces")), observe={"most": F.max("_pieces")})
    alone = parts.join(counts.where("_pieces = 1").select(SERIES), SERIES, "left_semi")
    fits = alone.join(plan, SERIES).mapInPandas(_fit_in_task, FIT_SCHEMA)
    if (counts.sparkseries_metrics["most"] or 0) < 2:
        return _kept(fits)
    long_ids = counts.where("_pieces > 1").select(SERIES)
    cut = parts.join(long_ids, SERIES, "left_semi")
    state = bounded(plan.join(long_ids, SERIES, "left_semi").withColumn("unsettled", F.lit(1)), observe={"open": F.max("unsettled")}, keep=_kept)
    while state.sparkseries_metrics["open"]:
        todo = state.where("unsettled > 0").select(SERIES, "plan").withColumn("all_fits", F.lit(False))
        sums = cut.join(todo, SERIES).mapInPandas(_sums, SUMS_SCHEMA)
        state = bounded(sums.groupBy(SERIES).cogroup(state.sparkseries_plain.groupBy(SERIES)).applyInPandas(_decide, STATE_SCHEMA),
                        observe={"open": F.max("unsettled")}, keep=_kept)
    return _kept(fits.unionByName(state.mapInPandas(_settled, FIT_SCHEMA)))


# ---------------------------------------------------------------- order search
GRID_COLUMNS = (SERIES, "p", "d", "q", "aic", "sse", "nobs", "params", "status")


def _orders(facts: DataFrame, d, most: int = MAX_ORDER) -> DataFrame:
    axis = F.sequence(F.lit(0), F.lit(most))
    rows = facts.select(SERIES, d.alias("d"), F.explode(axis).alias("p")).select("*", F.explode(axis).alias("q"))
    return rows.select("*", *[F.lit(0).alias(c) for c in ORDER_COLS[3:]])


def _search(prep: Prepared, facts: DataFrame | None = None, size: int | None = None):
    facts = facts if facts is not None else prep.varying()
    adf = adf_test(prep.clean.join(facts.select(SERIES), SERIES, "left_semi"), max_chunk=prep.max_chunk)
    dtab = bounded(facts.select(SERIES, "n").join(adf.select(SERIES, "p_value"), SERIES, "left").select(
        SERIES, "n", F.when(F.col("p_value") < 0.05, 0).otherwise(1).alias("d"), F.col("p_value").alias("adf_p_value")))
    parts = pieces(prep, dtab, MAX_ORDER + 1, size)
    fits = fit_orders(parts, _plan(_orders(dtab.sparkseries_plain, F.col("d")), True))
    return parts, fits, dtab


def order_grid(prep: Prepared, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """every candidate order fitted on the training part, as rows; plus d and the ADF p-value."""
    _, fits, dtab = _search(prep, facts)
    return fits.select(*GRID_COLUMNS), dtab


def best_order(grid: DataFrame) -> DataFrame:
    """The order of least AIC (then of least p, q) among the settled fits of each series."""
    ok = grid.where(F.col("status") == "ok")
    return ok.groupBy(SERIES).agg(F.min_by(F.struct("p", "d", "q", "aic"), F.struct("aic", "p", "q")).alias("b")) \
        .select(SERIES, "b.p", "b.d", "b.q", "b.aic")


# ---------------------------------------------------------------- evaluation
ERRORS_SCHEMA = f"{SERIES} string, points long, se double, ae double, ape double, zeros long"


def _error_row(sid, y: np.ndarray, err: np.ndarray):
    zeros = int((y == 0).sum())
    ape = float(np.sum(np.abs(err[y != 0] / y[y != 0]))) if len(y) else 0.0
    return [sid, len(y), float(err @ err), float(np.abs(err).sum()), ape, zeros]


def _holdout_errors(batches):
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            y = np.asarray(r.ys, float)
            at = max(r.lo, r.n_train)
            test = y[at - r.base:]
            if len(test):
                with np.errstate(over="ignore", invalid="ignore"):
                    pred = css.path(spec_of(r._asdict()), r.params, r.y_tail, r.e_tail, at - r.n_train, len(test))
                    out.append(_error_row(getattr(r, SERIES), test, test - pred))
        yield pd.DataFrame(out, columns=[SERIES, "points", "se", "ae", "ape", "zeros"])


def holdout_metrics(parts: DataFrame, fits: DataFrame, reach: int) -> DataFrame:
    """``(series_id, mse, rmse, mae, mape)``: the multi-step forecast of a training fit against the rest."""
    tails = last_values(parts, "n_train", reach)
    model = bounded(fits.join(tails, SERIES).select(SERIES, *ORDER_COLS, "params", "e_tail", "y_tail"))
    rows = parts.where(F.col("base") + F.size("ys") > F.col("n_train")).join(model, SERIES)
    return mean_errors(rows.mapInPandas(_holdout_errors, ERRORS_SCHEMA))


ENTRY_SCHEMA = f"{SERIES} string, c long, entry array<double>"


def _entries(sums: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    x = _open(state["plan"].iloc[0])[0]
    spec = spec_of(x)
    states = css.compose(_ordered(sums, 0, spec), spec)[5]
    return pd.DataFrame({SERIES: sums[SERIES], "c": sorted(sums["c"]), "entry": [list(s) for s in states]})


def _in_sample_errors(batches):
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            spec = spec_of(r._asdict())
            y, first = _cut(r, spec, False)
            z = css.piece_basis(y, first, spec, r.params)
            e = z[:, 0] + z[:, 1 + spec.k:1 + spec.k + spec.r] @ np.asarray(r.entry, float)
            skip = max(0, r.n_train - r.base - first)
            if skip < len(e):
                out.append(_error_row(getattr(r, SERIES), y[first + skip:], e[skip:]))
        yield pd.DataFrame(out, columns=[SERIES, "points", "se", "ae", "ape", "zeros"])


def in_sample_metrics(parts: DataFrame, fits: DataFrame) -> DataFrame:
    """One-step errors of the fits on all points, over the points of the hold-out part."""
    settled = fits.where(F.col("status").isin("ok", "not converged"))
    plan = bounded(_plan(settled, False, "params"))
    sums = parts.join(plan.withColumn("all_fits", F.lit(True)), SERIES).mapInPandas(_sums, SUMS_SCHEMA)
    entries = sums.groupBy(SERIES).cogroup(plan.sparkseries_plain.groupBy(SERIES)).applyInPandas(_entries, ENTRY_SCHEMA)
    rows = parts.join(bounded(entries), [SERIES, "c"]).join(bounded(settled.select(SERIES, *ORDER_COLS, "params")), SERIES)
    return mean_errors(rows.mapInPandas(_in_sample_errors, ERRORS_SCHEMA))


def fit_fixed(prep: Prepared, order: dict, size: int | None = None) -> DataFrame:
    """One given order (``ORDER_COLS``, missing ones 0) fitted on the training part of every series:
    rows of ``FIT_SCHEMA`` with the hold-out metrics."""
    spec = spec_of({c: 0 for c in ORDER_COLS} | order)
    facts = prep.varying().where(F.col("n") > spec.reach)
    parts = pieces(prep, facts, max(spec.reach, 1), size)
    orders = facts.select(SERIES, *[F.lit(order.get(c, 0)).alias(c) for c in ORDER_COLS])
    fits = fit_orders(parts, _plan(orders, True))
    settled = fits.where(F.col("status").isin("ok", "not converged"))
    return fits.join(holdout_metrics(parts, settled, max(spec.reach, 1)), SERIES, "left")


# ---------------------------------------------------------------- forecasts
def _forecast_steps(hmax: int):
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                spec = spec_of(r._asdict())
                values = css.head(spec, r.params, np.asarray(r.y_tail, float), np.asarray(r.e_tail, float), hmax)
                yield pd.DataFrame({SERIES: getattr(r, SERIES), "step": np.arange(1, hmax + 1, dtype="int32"), "forecast": values,
                                    "se": css.spread(spec, r.params, r.sse / max(r.nobs, 1), hmax)})
    return run


def _model(prep, facts, parts, train, chosen, horizons, model, reach, mode):
    """Refit ``chosen(series_id, order, params)`` on all points; forecast rows, refits and metrics."""
    if mode not in ("holdout", "in_sample"):
        raise ValueError("mode must be 'holdout' or 'in_sample'")
    refit = fit_orders(parts, _plan(chosen, False, "params"))
    done = refit.where(F.col("status").isin("ok", "not converged"))
    ahead = done.join(last_values(parts, "n", reach), SERIES).select(SERIES, *ORDER_COLS, "params", "sse", "nobs", "e_tail", "y_tail")
    hmax = max(horizons)
    fitted = ahead.mapInPandas(_forecast_steps(hmax), f"{SERIES} string, step int, forecast double, se double")
    steps = steps_for(prep, facts, horizons).join(fitted, [SERIES, "step"])
    lower, upper = spread_interval(F.col("forecast"), F.col("se"))
    rows = steps.select(SERIES, F.lit(model).alias("model"), F.col("horizon").cast("int").alias("horizon"),
                        F.col("step").cast("int").alias("step"), "ts", SEQ, "forecast", lower.alias("lower"), upper.alias("upper"))
    metrics = holdout_metrics(parts, train, reach) if mode == "holdout" else in_sample_metrics(parts, done)
    info = done.select(SERIES, F.lit(model).alias("model"), "status", *ORDER_COLS, "params",
                       (F.col("sse") / F.col("nobs")).alias("sigma2"))
    return rows, info.join(metrics, SERIES, "left")


INFO = ("p", "d", "q", "aic", "is_stationary", "p_value", "sigma2", "mse", "rmse", "mae", "mape")


def arima_forecast(prep: Prepared, horizons: Sequence[int], model: str = "arima", mode: str = "holdout"):
    """forecast rows and info rows (order, AIC, ADF, metrics by ``mode``, status of the fit)."""
    facts = prep.varying()
    parts, fits, dtab = _search(prep, facts)
    best = bounded(best_order(fits))
    train = fits.join(best.select(SERIES, "p", "d", "q"), [SERIES, "p", "d", "q"])
    rows, info = _model(prep, facts, parts, train, train, horizons, model, MAX_ORDER + 1, mode)
    info = info.join(best.select(SERIES, "aic"), SERIES).join(dtab.select(SERIES, "adf_p_value"), SERIES).select(
        SERIES, "model", "status", F.format_string("ARIMA(%d,%d,%d) of least AIC, conditional least squares", "p", "d", "q").alias("description"),
        "p", "d", "q", "aic", (F.col("adf_p_value") < 0.05).alias("is_stationary"), F.col("adf_p_value").alias("p_value"),
        "sigma2", "mse", "rmse", "mae", "mape", "params")
    return rows, info


def sarima_forecast(prep: Prepared, horizons: Sequence[int], model: str = "sarima", min_points: int = 28, mode: str = "holdout"):
    """fixed (1,1,1)(1,1,1,12); series need more points than parameters past the 26 it reaches
    back.  Same columns as :func:`arima_forecast`; AIC and hold-out metrics are NULL where the
    training part is too short for a fit."""
    spec = spec_of(SEASONAL)
    facts = prep.varying().where(F.col("n") >= max(min_points, spec.reach + 1))
    parts = pieces(prep, facts, spec.reach)
    orders = facts.select(SERIES, *[F.lit(v).alias(c) for c, v in SEASONAL.items()])
    train = fit_orders(parts, _plan(orders, True))
    known = F.when(F.col("status").isin("ok", "not converged"), F.col("params")).alias("params")
    rows, info = _model(prep, facts, parts, train.where(F.col("status").isin("ok", "not converged")),
                        train.select(SERIES, *ORDER_COLS, known), horizons, model, spec.reach, mode)
    aic = train.select(SERIES, F.when(F.col("status").isin("ok", "not converged"), F.col("aic")).alias("aic"))
    info = info.join(aic, SERIES).select(
        SERIES, "model", "status", F.lit("SARIMA(1,1,1)(1,1,1,12), conditional least squares").alias("description"),
        "p", "d", "q", "sp", "sd", "sq", "m", "aic", "sigma2", "mse", "rmse", "mae", "mape", "params")
    return rows, info
