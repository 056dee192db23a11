from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from tapewell.estimators import garch, ols
from tapewell.functions import distributions as dist


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(0)
    rows = []
    for i in range(12):
        for t in range(40):
            if r.random() < 0.8:
                x1, x2 = r.normal(i / 6, 1), r.normal(t / 20, 1)
                rows.append((f"s{i}", dt.date(2024, 1, 1) + dt.timedelta(t), 0.7 * x1 - 0.3 * x2 + i / 3 + np.sin(t) + r.normal(0, 0.5), x1, x2))
    return pd.DataFrame(rows, columns=["ticker", "date", "y", "x1", "x2"])


@pytest.fixture(scope="module")
def panel(spark, data):
    extra = pd.DataFrame([("s0", dt.date(2024, 3, 1), np.inf, 1.0, 1.0), ("s1", dt.date(2024, 3, 1), 1.0, None, 1.0)], columns=data.columns)
    return spark.createDataFrame(pd.concat([data, extra], ignore_index=True))


def dummies(data, entity, time):
    parts = [data[["x1", "x2"]].to_numpy(float)]
    if entity:
        parts.append(pd.get_dummies(data["ticker"]).to_numpy(float))
    if time:
        parts.append(pd.get_dummies(data["date"]).to_numpy(float)[:, 1 if entity else 0 :])
    if not entity and not time:
        parts.append(np.ones((len(data), 1)))
    return np.hstack(parts)


@pytest.mark.parametrize("entity,time", [(False, False), (True, False), (False, True), (True, True)])
@pytest.mark.parametrize("cluster", ["entity", "time"])
def test_against_dummy_variables(panel, data, entity, time, cluster):
    got = ols.run_panel_regression(panel, ols.RegressionSpec("t", "y", ["x1", "x2"], entity, time, cluster))
    x, y = dummies(data, entity, time), data["y"].to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    u = y - x @ beta
    assert got.n_obs == len(data)
    for k, name in enumerate(("x1", "x2")):
        assert got.coefficients[name] == pytest.approx(beta[k], abs=1e-7)
    bread = np.linalg.pinv(x.T @ x)
    key = "ticker" if cluster == "entity" else "date"
    meat = sum(np.outer(s, s) for s in (x[idx].T @ u[idx] for idx in data.groupby(key).indices.values()))
    g = data[key].nunique()
    k = 2 + (not entity and not time) + (data["ticker"].nunique() - 1 if entity and cluster != "entity" else 0) + (data["date"].nunique() - 1 if time and cluster != "time" else 0)
    cov = bread @ meat @ bread * g / (g - 1) * (len(data) - 1) / (len(data) - k)
    assert got.std_errors["x1"] == pytest.approx(np.sqrt(cov[0, 0]), rel=1e-5)
    assert got.r2 == pytest.approx(1 - u @ u / ((y - y.mean()) @ (y - y.mean())), abs=1e-7)
    assert 0 <= got.p_values["x1"] <= 1


def test_twoway_clusters_and_missing_columns(panel):
    got = ols.run_panel_regression(panel, ols.RegressionSpec("t", "y", ["x1"], True, False, "twoway"))
    assert got.std_errors["x1"] >= 0
    with pytest.raises(ValueError, match="missing columns"):
        ols.run_panel_regression(panel, ols.RegressionSpec("t", "y", ["nope"]))


def test_specifications():
    assert len(ols.baseline_spec(3).regressors) == 7 and len(ols.baseline_spec(3, split=False).regressors) == 5
    assert ols.extension_spec(1).regressors[-2:] == ["sentiment_intensity_std_lag1", "sentiment_disp_std_lag1"]
    assert ols.baseline_spec(5, measure="pk").target == "log_volatility_5d_pk"


def test_tails():
    assert dist.t_two_sided(2.0, 10) == pytest.approx(0.07338803)
    assert dist.chi2_upper(3.841458821, 1) == pytest.approx(0.05)
    assert dist.chi2_upper(50, 30) == pytest.approx(0.01240, abs=1e-4)
    assert dist.f_upper(4.0, 2, 30) == pytest.approx(0.0288446, abs=1e-6)
    assert dist.t_two_sided(None, 5) is None and dist.chi2_upper(0, 3) == 1.0


def loop(eps, x, w, a, b, d, v):
    out = [v]
    for t in range(1, len(eps)):
        out.append(max(w + a * eps[t - 1] ** 2 + b * out[-1] + float(x[t - 1] @ d), 1e-12))
    return np.array(out)


@pytest.mark.parametrize("n", [1, 2, 64, 65, 300])
def test_filter_against_the_loop(n):
    r = np.random.default_rng(n)
    eps, x = r.normal(0, 0.02, n), r.normal(0, 1, (n, 2))
    for d in (np.array([1e-6, 2e-6]), np.array([-3e-4, 2e-4])):  # the second meets the floor
        assert garch.variances(eps, x, 1e-5, 0.08, 0.9, d, 4e-4) == pytest.approx(loop(eps, x, 1e-5, 0.08, 0.9, d, 4e-4), rel=1e-9)


def test_golden_filter_and_likelihood():
    eps = np.array([0.01, -0.02, 0.015])
    v = float(np.var(eps, ddof=1))
    s = garch.variances(eps, np.zeros((3, 0)), 0.05 * v, 0.05, 0.9, np.zeros(0), v)
    assert s == pytest.approx([0.000358333333, 0.000345416667, 0.000348791667], abs=1e-12)
    assert garch.log_likelihood(eps, s) == pytest.approx(7.064344, abs=1e-5)
    assert garch.log_likelihood(eps, s, 1e7) == pytest.approx(garch.log_likelihood(eps, s) - np.log(2 * np.pi), abs=1e-4)


def simulated(n, w, a, b, seed):
    r = np.random.default_rng(seed)
    s, e = w / (1 - a - b), []
    for _ in range(n):
        e.append(float(np.sqrt(s) * r.normal()))
        s = w + a * e[-1] ** 2 + b * s
    return e


def test_panel_fit_recovers_parameters_and_tests_pooling(spark):
    rows = [(f"s{i}", dt.date(2015, 1, 1) + dt.timedelta(t), e) for i in range(3) for t, e in enumerate(simulated(1500, 2e-6, 0.10, 0.85, i))]
    panel = spark.createDataFrame(rows, "ticker string, date date, log_return double")
    spec = garch.GarchSpec(min_obs=100)
    stocks = garch.stock_arrays(panel, spec)
    fit = garch.fit_panel(stocks, spec, rounds=6, errors=True)
    assert fit.global_params["alpha"] == pytest.approx(0.10, abs=0.04)
    assert fit.stock_params["beta"].mean() == pytest.approx(0.85, abs=0.07)
    assert fit.n_params == 1 + 2 * 3 and fit.bic > fit.aic
    assert fit.global_errors["alpha"] is None or 0 < fit.global_errors["alpha"] < 0.1
    free = garch.fit_panel(stocks, garch.GarchSpec(min_obs=100, alpha="stock"), rounds=4)
    test = garch.likelihood_ratio("alpha", fit, free)
    assert test.lr >= 0 and test.df == 2 and 0 <= test.p_value <= 1
    table = fit.stock_table()
    assert (table["persistence"] < 1).all()
    assert garch.stock_errors(stocks, fit).count() == 6
    assert garch.conditional_variances(stocks, fit).count() == 4500
    assert garch.fit_panel(garch.stock_arrays(panel, garch.GarchSpec(min_obs=9999)), spec, rounds=1).n_obs == 0


def test_queries_fit_until_convergence(spark, monkeypatch):
    import inspect

    import pandas as pd

    from tapewell.queries import reference

    signature, calls = inspect.signature(garch.fit_panel), []

    def fit(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        spec = bound.arguments["spec"]
        calls.append((spec, bound.arguments["rounds"]))
        own = pd.DataFrame([{"ticker": "A", "n_obs": 40, "loglik": 1.0, **{n: 0.1 for n in spec.names}}])
        return garch.PanelGarchResult(spec, {}, own, 1.0, 7, len(calls) == 1, 39)

    monkeypatch.setattr(reference, "_returns", lambda *a: None)
    monkeypatch.setattr(reference, "full_panel", lambda *a: None)
    monkeypatch.setattr(garch, "stock_arrays", lambda *a: None)
    monkeypatch.setattr(garch, "fit_panel", fit)
    assert reference.garch_panel_fit(spark, "").first()["converged"] is True
    assert "delta_attention_std" in reference.garch_x_panel_fit(spark, "").columns
    tests = reference.lr_test_table(spark, "").collect()
    assert [r["parameter"] for r in tests] == ["alpha", "beta", "delta"] and not any(r["converged"] for r in tests)
    assert {rounds for _, rounds in calls} == {60} and all(len(s.exog) == 3 for s, _ in calls[1:])


def test_joint_fit_and_errors_against_a_dense_optimiser(spark):
    """All parameters of four stocks in one vector: nothing higher nearby, and the pooled error is that of the whole Hessian."""
    series = {f"s{i}": np.array(simulated(600, 2e-6 * (i + 1), 0.08, 0.88, 40 + i)) for i in range(4)}
    rows = [(k, dt.date(2015, 1, 1) + dt.timedelta(t), float(e)) for k, v in series.items() for t, e in enumerate(v)]
    spec = garch.GarchSpec(min_obs=100)
    fit = garch.fit_panel(garch.stock_arrays(spark.createDataFrame(rows, "ticker string, date date, log_return double"), spec), spec, errors=True)
    assert fit.converged
    names = list(fit.stock_params["ticker"])
    none = np.zeros((600, 0))

    def joint(v):
        return sum(garch.evaluate(spec, series[k], none, {"alpha": v[0], "omega": math.exp(v[1 + 2 * i]), "beta": v[2 + 2 * i]}) for i, k in enumerate(names))

    at = np.array([fit.global_params["alpha"], *[x for r in fit.stock_params.itertuples() for x in (math.log(r.omega), r.beta)]])
    assert joint(at) == pytest.approx(fit.loglik, abs=1e-6)
    _, top = garch._climb(joint, at, np.array([0.02, *[0.2, 0.02] * 4]), 3000, 1e-9)
    assert top - fit.loglik < 0.05
    _, hessian = garch._derivatives(joint, at, 1e-4)
    assert fit.global_errors["alpha"] == pytest.approx(math.sqrt(np.linalg.inv(-hessian)[0, 0]), rel=0.05)


def test_filter_takes_time_in_proportion(spark):
    import time

    from pyspark.sql import functions as F

    def seconds(n):
        df = spark.range(8).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i) / 100).alias("y")).cache()
        df.count()
        began = time.perf_counter()
        df.select(F.size(garch.filter_column(F.col("y"), F.lit(1e-5), F.lit(0.05), F.lit(0.9), F.lit(1e-4))).alias("n")).agg(F.sum("n")).collect()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(200_000) < 40 * max(seconds(20_000), 0.05)


def test_two_way_regressions_hold_no_memory(spark):
    r = np.random.default_rng(0)
    panel = spark.createDataFrame([(f"t{i}", dt.date(2020, 1, 1) + dt.timedelta(d), float(r.normal()), float(r.normal())) for i in range(5) for d in range(30)], "ticker string, date date, y double, x double")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    ols.run_panel_regression(panel, ols.RegressionSpec("r", "y", ["x"]))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_garch_tables(spark, tmp_path):
    import json

    from tapewell.sinks import files as sinks

    rows = [(f"s{i}", dt.date(2015, 1, 1) + dt.timedelta(t), e) for i in range(2) for t, e in enumerate(simulated(300, 2e-6, 0.10, 0.85, i))]
    stocks = garch.stock_arrays(spark.createDataFrame(rows, "ticker string, date date, log_return double"), garch.GarchSpec(min_obs=100))
    fit = garch.fit_panel(stocks, garch.GarchSpec(min_obs=100), rounds=2)
    sinks.garch_tables(fit, str(tmp_path / "g"))
    sinks.likelihood_ratio_tables([garch.likelihood_ratio("alpha", fit, fit)], str(tmp_path / "lr"))
    assert len(json.loads((tmp_path / "g.json").read_text())["stocks"]) == 2 and "tabular" in (tmp_path / "g.tex").read_text()
    assert (tmp_path / "lr.csv").read_text().startswith("parameter,")
