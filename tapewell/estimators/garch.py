"""Panel GARCH(1,1)-X: filter, likelihood, block-coordinate fit, standard errors, likelihood-ratio tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.functions.distributions import chi2_upper

FLOOR = 1e-12
_BLOCK = 64


# ---------------------------------------------------------------- filter
def filter_column(series: Column, omega: Column, alpha: Column, beta: Column, start: Column) -> Column:
    """Conditional variances of an ordered array of returns, in time linear in its length; no exogenous terms."""

    @F.pandas_udf("array<double>")
    def filtered(y: pd.Series, o: pd.Series, a: pd.Series, b: pd.Series, v: pd.Series) -> pd.Series:
        none = np.zeros(0)
        return pd.Series([variances(np.asarray(e, float), np.zeros((len(e), 0)), *map(float, p), none, float(s)) for e, *p, s in zip(y, o, a, b, v)])

    number = lambda c: c.cast("double")
    return filtered(series, number(omega), number(alpha), number(beta), number(start))


def variances(eps: np.ndarray, exog: np.ndarray, omega: float, alpha: float, beta: float, delta: np.ndarray, start: float) -> np.ndarray:
    """sigma2[t] = omega + alpha eps[t-1]^2 + beta sigma2[t-1] + delta'x[t-1], floored; sigma2[0] = start.

    The recursion is linear in its inputs, so it runs block by block with one small triangular product each;
    only where the floor would bite it goes step by step.
    """
    n = len(eps)
    out = np.empty(n)
    if n == 0:
        return out
    out[0] = start
    u = omega + alpha * eps[:-1] ** 2
    if delta.size:
        u = u + exog[:-1] @ delta
    powers = beta ** np.arange(_BLOCK + 1)
    lags = np.subtract.outer(np.arange(_BLOCK), np.arange(_BLOCK))
    lower = np.where(lags >= 0, powers[np.maximum(lags, 0)], 0.0)
    last = start
    for a in range(0, n - 1, _BLOCK):
        part = u[a : a + _BLOCK]
        m = len(part)
        out[a + 1 : a + 1 + m] = lower[:m, :m] @ part + powers[1 : m + 1] * last
        last = out[a + m]
    if out.min() < FLOOR:
        for i in range(1, n):
            out[i] = max(u[i - 1] + beta * out[i - 1], FLOOR)
    return out


def log_likelihood(eps: np.ndarray, sigma2: np.ndarray, nu: float | None = None) -> float:
    """Gaussian without its constant, or Student t with ``nu`` degrees of freedom scaled to unit variance; the first
    observation doesn't count."""
    e, s = eps[1:], sigma2[1:]
    if nu is None:
        return float(-0.5 * np.sum(np.log(s) + e * e / s))
    c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    return float(np.sum(c - 0.5 * np.log(s) - (nu + 1) / 2 * np.log1p(e * e / (s * (nu - 2)))))


# ---------------------------------------------------------------- specification
@dataclass(frozen=True)
class GarchSpec:
    """Scope of each parameter: 'stock' or 'global'; ``delta`` may give a scope per exogenous column."""

    exog: Sequence[str] = ()
    omega: str = "stock"
    alpha: str = "global"
    beta: str = "stock"
    delta: str | dict[str, str] = "stock"
    returns: str = "log_return"
    mu: str = "zero"  # or a scope
    dist: str = "normal"  # or "t"
    min_obs: int = 250

    def scope(self, name: str) -> str:
        if name in ("mu", "omega", "alpha", "beta"):
            return getattr(self, name)
        if name == "nu":
            return "global"
        return self.delta if isinstance(self.delta, str) else self.delta.get(name, "stock")

    @property
    def names(self) -> list[str]:
        return [*(["mu"] if self.mu != "zero" else []), "omega", "alpha", "beta", *self.exog, *(["nu"] if self.dist == "t" else [])]

    @property
    def global_names(self) -> list[str]:
        return [n for n in self.names if self.scope(n) == "global"]

    @property
    def stock_names(self) -> list[str]:
        return [n for n in self.names if self.scope(n) == "stock"]

    def count(self, stocks: int) -> int:
        return len(self.global_names) + stocks * len(self.stock_names)


_BOUNDS = {"omega": (1e-10, 1.0), "alpha": (1e-6, 0.999), "beta": (1e-6, 0.999), "nu": (2.1, 100.0)}


def start_values(eps: np.ndarray) -> dict[str, float]:
    return {"mu": 0.0, "omega": 0.05 * float(np.var(eps, ddof=1)), "alpha": 0.05, "beta": 0.90, "nu": 8.0}


def stock_arrays(panel: DataFrame, spec: GarchSpec) -> DataFrame:
    """(ticker, n_obs, y, x): one row per stock with at least ``min_obs`` returns; arrays in order of the date.

    A stock's series holds one entry per trading day. Missing exogenous values are 0.
    """
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    y = finite(F.col(spec.returns).cast("double"))
    xs = [F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(spec.exog)]
    rows = panel.select("ticker", "date", y.alias("y"), *xs).where("y IS NOT NULL")
    packed = rows.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "y", *[f"x{i}" for i in range(len(spec.exog))]))).alias("s"))
    x = F.transform("s", lambda r: F.array(*[r[f"x{i}"] for i in range(len(spec.exog))]).cast("array<double>"))
    return packed.select("ticker", F.size("s").alias("n_obs"), F.transform("s", lambda r: r["y"]).alias("y"), x.alias("x")).where(F.col("n_obs") >= spec.min_obs)


def _arrays(row, width: int) -> tuple[np.ndarray, np.ndarray]:
    y = np.asarray(row.y, float)
    x = np.array([np.asarray(v, float) for v in row.x]).reshape(len(y), width) if width else np.zeros((len(y), 0))
    return y, x


def evaluate(spec: GarchSpec, y: np.ndarray, x: np.ndarray, p: dict[str, float]) -> float:
    """Log likelihood of one stock; -inf where the parameters aren't admissible."""
    if p["omega"] <= 0 or p["alpha"] < 0 or p["beta"] < 0 or p["alpha"] + p["beta"] >= 1 or p.get("nu", 8.0) <= 2:
        return -math.inf
    e = y - p.get("mu", 0.0)
    s = variances(e, x, p["omega"], p["alpha"], p["beta"], np.array([p[c] for c in spec.exog]), float(np.var(y, ddof=1)))
    return log_likelihood(e, s, p["nu"] if spec.dist == "t" else None)


def _climb(f, start: np.ndarray, steps: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, float]:
    """Maximum by the simplex method of Nelder and Mead."""
    n = len(start)
    points = [start] + [start + np.eye(n)[i] * steps[i] for i in range(n)]
    simplex = sorted(((f(p), p) for p in points), key=lambda v: -v[0])
    for _ in range(rounds):
        if abs(simplex[0][0] - simplex[-1][0]) < tolerance and math.isfinite(simplex[-1][0]):
            break
        centre = np.mean([p for _, p in simplex[:-1]], axis=0)
        worst = simplex[-1]
        move = lambda k: centre + k * (centre - worst[1])
        p = move(1.0)
        v = f(p)
        if v > simplex[0][0]:
            q = move(2.0)
            w = f(q)
            new = (w, q) if w > v else (v, p)
        elif v > simplex[-2][0]:
            new = (v, p)
        else:
            q = move(0.5 if v > worst[0] else -0.5)
            w = f(q)
            if w > max(v, worst[0]):
                new = (w, q)
            else:
                best = simplex[0]
                simplex = sorted([best, *[(f(s), s) for s in (best[1] + 0.5 * (p - best[1]) for _, p in simplex[1:])]], key=lambda v: -v[0])
                continue
        simplex = sorted([*simplex[:-1], new], key=lambda v: -v[0])
    return simplex[0][1], simplex[0][0]


def _free(name: str, value: float, scale: float) -> float:
    """Parameter to an unbounded number: log for positive ones, logit for shares, scaled otherwise."""
    if name == "omega":
        return math.log(max(value, _BOUNDS["omega"][0]))
    if name in ("alpha", "beta"):
        value = min(max(value, 1e-6), 0.999)
        return math.log(value / (1 - value))
    if name == "nu":
        return math.log(max(value - 2.05, 1e-3))
    return value / scale


def _bound(name: str, value: float, scale: float) -> float:
    if name == "omega":
        return min(math.exp(min(value, 0.0)), 1.0)
    if name in ("alpha", "beta"):
        return min(max(1 / (1 + math.exp(-max(min(value, 30), -30))), 1e-6), 0.999)
    if name == "nu":
        return min(2.05 + math.exp(min(value, 4.6)), 100.0)
    return value * scale


def fit_stock(spec: GarchSpec, y: np.ndarray, x: np.ndarray, fixed: dict[str, float], start: dict[str, float], rounds: int = 250) -> tuple[dict[str, float], float]:
    """The stock's own parameters given the global ones."""
    names = spec.stock_names
    if not names:
        p = {**start, **fixed}
        return {}, evaluate(spec, y, x, p)
    scale = float(np.var(y, ddof=1)) or 1e-8
    at = np.array([_free(n, start[n], scale) for n in names])
    steps = np.array([0.5 if n in ("omega", "alpha", "beta", "nu") else 0.05 for n in names])
    value = lambda v: evaluate(spec, y, x, {**start, **fixed, **{n: _bound(n, a, scale) for n, a in zip(names, v)}})
    best, top = _climb(value, at, steps, rounds, 1e-7)
    return {n: _bound(n, a, scale) for n, a in zip(names, best)}, top


@dataclass
class PanelGarchResult:
    spec: GarchSpec
    global_params: dict[str, float]
    stock_params: pd.DataFrame  # ticker, n_obs, loglik and a column per stock parameter
    loglik: float
    rounds: int
    converged: bool
    n_obs: int
    global_errors: dict[str, float | None] = field(default_factory=dict)

    @property
    def n_params(self) -> int:
        return self.spec.count(len(self.stock_params))

    @property
    def aic(self) -> float:
        return 2 * self.n_params - 2 * self.loglik

    @property
    def bic(self) -> float:
        return self.n_params * math.log(max(self.n_obs, 1)) - 2 * self.loglik

    def stock_table(self) -> pd.DataFrame:
        """One row per stock with every parameter; pooled ones repeat. Persistence is alpha + beta."""
        out = self.stock_params.copy()
        for name, value in self.global_params.items():
            out[name] = value
        out["persistence"] = out["alpha"] + out["beta"]
        return out.rename(columns={c: f"delta_{c}" for c in self.spec.exog})


def _table(spark, params: pd.DataFrame, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(params[["ticker", *names]].values.tolist(), "ticker string" + "".join(f", `{n}` double" for n in names))


#: Stocks whose parameters come to the driver: one short row each.
MOST_STOCKS = 1_000_000


def _concave(matrix: np.ndarray, least: float) -> np.ndarray:
    """``matrix`` with all curvatures at least ``least`` downwards, so that it can be inverted and leads uphill."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * -np.maximum(np.abs(values), least)) @ vectors.T


def _derivatives(f, at: np.ndarray, h: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian by central differences."""
    n = len(at)
    unit, middle = np.eye(n) * h, f(at)
    up, down = [f(at + u) for u in unit], [f(at - u) for u in unit]
    gradient, hessian = np.zeros(n), np.zeros((n, n))
    for i in range(n):
        gradient[i] = (up[i] - down[i]) / (2 * h)
        hessian[i, i] = (up[i] - 2 * middle + down[i]) / (h * h)
        for j in range(i):
            both = f(at + unit[i] + unit[j]) - f(at + unit[i] - unit[j]) - f(at - unit[i] + unit[j]) + f(at - unit[i] - unit[j])
            hessian[i, j] = hessian[j, i] = both / (4 * h * h)
    ok = np.isfinite(gradient).all() and np.isfinite(hessian).all()
    return (gradient, hessian) if ok else (np.zeros(n), -np.eye(n))


def fit_panel(stocks: DataFrame, spec: GarchSpec, rounds: int = 60, tolerance: float = 1e-2, errors: bool = False, start: dict[str, float] | None = None) -> PanelGarchResult:
    """Joint maximum likelihood. ``stocks`` comes from ``stock_arrays`` and is kept in memory.

    A round is a Newton step for the shared parameters in the joint likelihood. The joint Hessian has one block for the shared
    parameters and one per stock, and stocks only touch the shared block; so each stock frees its own share of that block from
    its own parameters (Schur complement), and the sums of these small matrices, one job, are all that the driver needs. Then
    every stock climbs again from where it stood with the shared parameters held, one job; a step that doesn't raise the
    likelihood is shortened. Parameters keep their bounds by logs and logits. Without shared parameters one pass is the
    answer. Stops when a round gains less than ``tolerance``; ``converged`` says that the predicted gain was below it too.
    ``errors``: standard errors of the shared parameters from the joint Hessian.
    """
    spark = stocks.sparkSession
    width = len(spec.exog)
    held = stocks.persist()
    shared = {n: (start or {}).get(n, {"alpha": 0.05, "beta": 0.90, "nu": 8.0, "omega": 1e-5}.get(n, 0.0)) for n in spec.global_names}
    own_shape = "ticker string, n_obs int, loglik double" + "".join(f", `{n}` double" for n in spec.stock_names)
    names, mine = spec.global_names, spec.stock_names
    k = len(names)
    unit = 1e-4  # scale of shared effects

    def with_known(params: pd.DataFrame | None) -> DataFrame:
        return held if params is None or not mine else held.join(_table(spark, params, mine), "ticker")

    def stock_block(fixed: dict[str, float], params: pd.DataFrame | None) -> pd.DataFrame:
        def run(frames):
            for frame in frames:
                rows = []
                for row in frame.itertuples(index=False):
                    y, x = _arrays(row, width)
                    known = {} if params is None else {n: getattr(row, n) for n in mine}
                    own, value = fit_stock(spec, y, x, fixed, {**{c: 0.0 for c in spec.exog}, **start_values(y), **known}, 80 if known else 250)
                    rows.append((row.ticker, len(y), value, *[own[n] for n in mine]))
                yield pd.DataFrame(rows, columns=["ticker", "n_obs", "loglik", *mine])

        out = with_known(params).mapInPandas(run, own_shape).limit(MOST_STOCKS + 1).toPandas()
        if len(out) > MOST_STOCKS:
            raise ValueError("too many stocks for one table of parameters")
        return out.sort_values("ticker").reset_index(drop=True)

    def curvature(fixed: dict[str, float], params: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the shared parameters, freed from those of the stocks."""

        def run(frames):
            total = np.zeros(k + k * k)
            for frame in frames:
                for row in frame.itertuples(index=False):
                    y, x = _arrays(row, width)
                    scale = float(np.var(y, ddof=1)) or 1e-8
                    scales = [unit] * k + [scale] * len(mine)
                    at = np.array([_free(n, v, c) for n, v, c in zip([*names, *mine], [*(fixed[n] for n in names), *(getattr(row, n) for n in mine)], scales)])
                    f = lambda v: evaluate(spec, y, x, {**start_values(y), **{n: _bound(n, a, c) for n, a, c in zip([*names, *mine], v, scales)}})
                    g, h = _derivatives(f, at)
                    if mine:
                        pull = h[:k, k:] @ np.linalg.inv(_concave(h[k:, k:], 1e-6))
                        g, h = g[:k] - pull @ g[k:], h[:k, :k] - pull @ h[k:, :k]
                    total += np.concatenate([g, h.ravel()])
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        got = with_known(params).mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros(k + k * k)
        flat[got["i"].to_numpy(int)] = got["v"].to_numpy(float)
        return flat[:k], flat[k:].reshape(k, k)

    params = stock_block(shared, None)
    last, done, converged = float(params["loglik"].sum()), 1, not names or not len(params)
    while names and len(params) and done < rounds and not converged:
        done += 1
        gradient, hessian = curvature(shared, params)
        step = np.linalg.solve(-_concave(hessian, 1e-6), gradient)
        expected = float(gradient @ step) / 2
        step = step / max(1.0, np.abs(step).max() / 2)
        at = np.array([_free(n, shared[n], unit) for n in names])
        gain = 0.0
        for part in (1.0, 0.3, 0.1, 0.03, 0.01):
            trial = {n: _bound(n, float(a), unit) for n, a in zip(names, at + part * step)}
            own = stock_block(trial, params)
            value = float(own["loglik"].sum())
            if value > last:
                gain, last, shared, params = value - last, value, trial, own
                break
        if gain < tolerance:
            converged = expected < max(tolerance, 1e-6 * abs(last))
            break
    found: dict[str, float | None] = {}
    if errors and names and len(params):
        _, hessian = curvature(shared, params)
        variance = np.diag(np.linalg.pinv(-(hessian + hessian.T) / 2))
        for n, v in zip(names, variance):
            a = _free(n, shared[n], unit)
            slope = (_bound(n, a + 1e-5, unit) - _bound(n, a - 1e-5, unit)) / 2e-5
            found[n] = float(abs(slope) * math.sqrt(v)) if v > 0 else None
    held.unpersist()
    return PanelGarchResult(spec, shared, params, last, done, converged, int((params["n_obs"] - 1).sum()) if len(params) else 0, found)


def stock_errors(stocks: DataFrame, result: PanelGarchResult) -> DataFrame:
    """(ticker, parameter, estimate, se) by each stock's own Hessian, the global parameters held."""
    spec, width = result.spec, len(result.spec.exog)
    shared = result.global_params
    own = _table(stocks.sparkSession, result.stock_params, spec.stock_names)

    def run(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                y, x = _arrays(row, width)
                names = spec.stock_names
                at = np.array([getattr(row, n) for n in names])
                h = 1e-4 * np.maximum(np.abs(at), 1e-6)
                f = lambda v: evaluate(spec, y, x, {**start_values(y), **shared, **dict(zip(names, v))})
                hess = np.zeros((len(names), len(names)))
                for i in range(len(names)):
                    for j in range(i, len(names)):
                        a, b = np.eye(len(names))[i] * h[i], np.eye(len(names))[j] * h[j]
                        hess[i, j] = hess[j, i] = (f(at + a + b) - f(at + a - b) - f(at - a + b) + f(at - a - b)) / (4 * h[i] * h[j])
                try:
                    var = np.diag(np.linalg.inv(-hess)) if np.isfinite(hess).all() else np.full(len(names), np.nan)
                except np.linalg.LinAlgError:
                    var = np.full(len(names), np.nan)
                rows += [(row.ticker, n, float(a), float(math.sqrt(v)) if v > 0 else None) for n, a, v in zip(names, at, var)]
            yield pd.DataFrame(rows, columns=["ticker", "parameter", "estimate", "se"])

    return stocks.join(own, "ticker").mapInPandas(run, "ticker string, parameter string, estimate double, se double")


def conditional_variances(stocks: DataFrame, result: PanelGarchResult) -> DataFrame:
    """(ticker, t, sigma2) of the fitted model."""
    spec, width, shared = result.spec, len(result.spec.exog), result.global_params
    own = _table(stocks.sparkSession, result.stock_params, spec.stock_names)

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                y, x = _arrays(row, width)
                p = {**shared, **{n: getattr(row, n) for n in spec.stock_names}}
                s = variances(y - p.get("mu", 0.0), x, p["omega"], p["alpha"], p["beta"], np.array([p[c] for c in spec.exog]), float(np.var(y, ddof=1)))
                yield pd.DataFrame({"ticker": row.ticker, "t": np.arange(len(s)), "sigma2": s})

    return stocks.join(own, "ticker").mapInPandas(run, "ticker string, t long, sigma2 double")


@dataclass(frozen=True)
class LikelihoodRatio:
    parameter: str
    restricted: float
    unrestricted: float
    lr: float
    df: int
    p_value: float
    converged: bool  # both fits


def likelihood_ratio(parameter: str, restricted: PanelGarchResult, unrestricted: PanelGarchResult) -> LikelihoodRatio:
    lr = max(0.0, 2 * (unrestricted.loglik - restricted.loglik))
    df = unrestricted.n_params - restricted.n_params
    return LikelihoodRatio(parameter, restricted.loglik, unrestricted.loglik, lr, df, chi2_upper(lr, df), restricted.converged and unrestricted.converged)


def pooling_tests(stocks: DataFrame, base: GarchSpec, parameters: Sequence[str] = ("alpha", "beta", "delta"), rounds: int = 60) -> list[LikelihoodRatio]:
    """Is the parameter the same for all stocks? All tested parameters pooled against one of them free; the pooled fit is shared."""
    pooled = replace(base, **{p: "global" for p in parameters})
    restricted = fit_panel(stocks, pooled, rounds)
    return [likelihood_ratio(p, restricted, fit_panel(stocks, replace(pooled, **{p: "stock"}), rounds, start=restricted.global_params)) for p in parameters]
