"""Models against plain numpy on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import panelmath as P
from tidepanel.functions import statespace as S
from tidepanel.operators import bayes, factor, impute, inverse, transform, univariate


def rand_panel(n=9, t=60, seed=3, missing=0.05):
    rng = np.random.default_rng(seed)
    f = np.zeros((t, 2))
    for i in range(1, t):
        f[i] = 0.7 * f[i - 1] + rng.normal(size=2)
    x = f @ rng.normal(size=(2, n)) + 0.3 * rng.normal(size=(t, n))
    x = 50 + np.cumsum(x, axis=0) * 0.1 + x
    x[rng.random(x.shape) < missing] = np.nan
    return x


def columns(x):
    return {f"s{i}": x[:, i].tolist() for i in range(x.shape[1])}


CODES = {f"s{i}": 1 + i % 7 for i in range(9)}


def test_ar_least_squares(make_panel):
    rng = np.random.default_rng(0)
    y = np.zeros(200)
    for i in range(2, 200):
        y[i] = 1 + 0.5 * y[i - 1] - 0.3 * y[i - 2] + rng.normal()
    packed = univariate.pack(transform.stationary(make_panel({"y": y.tolist(), "same": [3.0] * 40, "short": [1.0, 2.0] * 9})))
    fits = {r.series: r.fit for r in univariate.fit_ar(packed, 3).collect()}
    x = np.column_stack([np.ones(198), y[1:-1], y[:-2]])
    b, rss = np.linalg.lstsq(x, y[2:], rcond=None)[:2]
    h1 = b @ [1, y[-1], y[-2]]
    h2 = b @ [1, h1, y[-1]]
    assert fits["y"].status == "ok" and fits["y"].order == "2"
    assert fits["y"].path[:2] == pytest.approx([h1, h2])
    assert fits["y"].aic == pytest.approx(198 * (np.log(rss[0] / 198) + np.log(2 * np.pi) + 1) + 2 * 4)
    assert fits["same"].status == "fallback" and fits["same"].path == [3.0] * 3
    assert fits["short"].status == "short" and fits["short"].path == [None] * 3


def two_regressions(y, p, q, horizon, skip=None):
    """Long autoregression, then the value on its lags and those of the innovations, by plain numpy."""
    n = len(y)
    m = min(8, n // 4)
    lagged = lambda a, k: np.concatenate([np.full(k, np.nan), a[: n - k]])
    x = np.column_stack([np.ones(n)] + [lagged(y, k) for k in range(1, m + 1)])
    e = np.full(n, np.nan)
    e[m:] = y[m:] - x[m:] @ np.linalg.lstsq(x[m:], y[m:], rcond=None)[0]
    x = np.column_stack([np.ones(n)] + [lagged(y, k) for k in range(1, p + 1)] + [lagged(e, k) for k in range(1, q + 1)])
    first = m + (max(p, q) if skip is None else skip)
    c = np.linalg.lstsq(x[first:], y[first:], rcond=None)[0]
    rss, size = ((y[first:] - x[first:] @ c) ** 2).sum(), n - first
    past, heard = list(y), list(e) + [0.0] * horizon
    for h in range(horizon):
        past.append(c[0] + sum(c[k] * past[-k] for k in range(1, p + 1)) + sum(c[p + k] * heard[n + h - k] for k in range(1, q + 1)))
    return np.array(past[n:]), size * (np.log(rss / size) + np.log(2 * np.pi) + 1) + 2 * (p + q + 2), c


def test_arma_by_two_regressions(make_panel):
    rng = np.random.default_rng(1)
    e = rng.normal(size=900)
    y = np.zeros(900)
    for i in range(1, 900):
        y[i] = 0.6 * y[i - 1] + e[i] + 0.4 * e[i - 1]
    y = 1e6 + 50 * y
    packed = univariate.pack(transform.stationary(make_panel({"y": y.tolist(), "z": (y[:40] / 7).tolist()})))
    grid = {(r.series, r.p, r.q): r for r in univariate.arima_grid(packed, 4).collect()}
    for p in range(4):
        for q in range(4):
            if p + q and ("z", p, q) in grid:
                for name, v in (("y", y), ("z", y[:40] / 7)):
                    path, aic, _ = two_regressions(v, p, q, 4, skip=3)
                    np.testing.assert_allclose(grid[name, p, q].fit.path, path, rtol=1e-8)
                    assert grid[name, p, q].aic == pytest.approx(aic, rel=1e-7)
    assert len([k for k in grid if k[0] == "y"]) == 15
    # a known process is found again
    _, _, c = two_regressions(y, 1, 1, 1)
    assert c[1] == pytest.approx(0.6, abs=0.1) and c[2] == pytest.approx(0.4, abs=0.1)
    assert min((r.aic, k[1:]) for k, r in grid.items() if k[0] == "y")[1] in {(1, 1), (1, 2), (2, 1)}
    for q in (1, 5):
        fit = {r.series: r.fit for r in univariate.fit_ma(packed, 4, order=q).collect()}
        np.testing.assert_allclose(fit["y"].path, two_regressions(y, 0, q, 4)[0], rtol=1e-9)
        assert fit["y"].order == f"0,0,{q}" and fit["z"].status == "ok"


def test_an_explosive_order_is_left_out(make_panel):
    y = (1.2 ** np.arange(60) + np.random.default_rng(3).normal(size=60)).tolist()
    packed = univariate.pack(transform.stationary(make_panel({"y": y})))
    assert (1, 0) not in {(r.p, r.q) for r in univariate.arima_grid(packed, 2).collect()}
    fit = univariate.fit_arima(packed, 2, order=(1, 0, 0)).first().fit
    assert fit.status == "fallback" and fit.path == [y[-1]] * 2


def test_random_walk_and_fallbacks(make_panel):
    rng = np.random.default_rng(5)
    walk = np.cumsum(rng.normal(size=60))
    panel = transform.stationary(make_panel({"w": walk.tolist(), "short": [None] * 40 + walk[40:].tolist(), "same": [2.0] * 60}))
    rows = {r.series: r for r in univariate.fit_arima(univariate.pack(panel), 2, order=(0, 1, 0)).collect()}
    assert rows["w"].fit.path == pytest.approx([walk[-1]] * 2)
    assert rows["short"].fit.status == "short" and rows["short"].fit.path == [None, None]
    assert rows["same"].fit.path == [2.0, 2.0]
    means = {r.series: r.fit for r in univariate.fit_ma(univariate.pack(panel), 2).collect()}
    assert means["same"].path == [2.0, 2.0] and means["same"].status == "fallback"


def test_differenced_model(make_panel):
    """A drift that dies out: the differences are an AR(1) without constant, summed up again once or twice."""
    rng = np.random.default_rng(6)
    d = np.zeros(80)
    for i in range(1, 80):
        d[i] = 0.7 * d[i - 1] + rng.normal()
    for times in (1, 2):
        y = d
        for _ in range(times):
            y = np.cumsum(y)
        x = np.diff(y, n=times)
        m = min(8, len(x) // 4)
        a = (x[m:-1] @ x[m + 1 :]) / (x[m:-1] @ x[m:-1])
        path = x[-1] * a ** np.arange(1, 4)
        for level in range(times, 0, -1):
            path = np.diff(y, n=level - 1)[-1] + np.cumsum(path)
        fit = univariate.fit_arima(univariate.pack(transform.stationary(make_panel({"y": y.tolist()}))), 3, order=(1, times, 0)).first().fit
        np.testing.assert_allclose(fit.path, path, rtol=1e-8)


def test_grid_picks_least_aic(make_panel):
    rng = np.random.default_rng(2)
    panel = transform.stationary(make_panel({f"s{i}": rng.normal(size=60).tolist() for i in range(3)}))
    packed = univariate.pack(panel)
    grid = univariate.arima_grid(packed, 1).collect()
    best = {}
    for r in grid:
        best[r.series] = min(best.get(r.series, (np.inf, 0, 0)), (r.aic, r.p, r.q))
    for r in univariate.fit_arima(packed, 1).collect():
        assert r.fit.order == f"{best[r.series][1]},0,{best[r.series][2]}"


def test_fleet_orders_match_the_sql_style_rule(make_panel):
    x = rand_panel(6, 80, missing=0)
    panel = transform.stationary(make_panel(columns(x)))
    acf = univariate.autocorrelation(panel)
    expected = {r.series: r.order for r in univariate.choose_order(univariate.partial_autocorrelations(acf)).collect()}
    got = {r.series: int(r.fit.order) for r in univariate.fit_ar(univariate.pack(panel), 1).collect()}
    assert got == expected


def test_numpy_rows_match_window_operators(make_panel):
    x = np.abs(rand_panel(9, 40)) + 1
    panel = make_panel(columns(x), CODES)
    native = transform.stationary(panel).orderBy("series", "t").collect()
    block = P.stationary_rows(x.T, np.array([CODES[f"s{i}"] for i in range(9)]))
    got = np.array([np.nan if r.x is None else r.x for r in native]).reshape(9, 40)
    np.testing.assert_allclose(got, block, atol=1e-9)
    for rule in ("short", "first"):
        days = (np.datetime64("2000-01", "M") + np.arange(40)).astype("datetime64[D]").astype(float)
        z, _, _, usable = P.ready_rows(block, 0.8, rule, days)
        rows = impute.model_ready(transform.stationary(panel), rule=rule).orderBy("series", "t").collect()
        names = sorted({r.series for r in rows})
        assert names == [f"s{i}" for i in range(9) if usable[i]]
        np.testing.assert_allclose(np.array([r.z for r in rows]).reshape(len(names), -1), z[usable], atol=1e-8)


def brute_pca_var(levels, codes, k, order, horizon, min_obs):
    """Whole-panel factor forecast with plain numpy; levels is (T, N)."""
    x = P.stationary_rows(levels.T, codes).T
    x_rows = x[~np.isnan(x).all(axis=1)]
    mu, sd = np.nanmean(x_rows, axis=0), np.nanstd(x_rows, axis=0, ddof=1)
    sd[~(sd > 0)] = 1
    z = (x_rows - mu) / sd
    ok = (~np.isnan(z)).sum(axis=0) >= min_obs
    zf = np.nan_to_num(z[:, ok])
    u, s, vt = np.linalg.svd(zf, full_matrices=False)
    f = u[:, :k] * s[:k]
    d = np.column_stack([np.ones(len(f) - order)] + [f[order - i : len(f) - i] for i in range(1, order + 1)])
    b = np.linalg.lstsq(d, f[order:], rcond=None)[0]
    hist = list(f[-order:])
    for _ in range(horizon):
        hist.append(np.concatenate([[1.0]] + [hist[-i] for i in range(1, order + 1)]) @ b)
    std = np.array(hist[order:]) @ vt[:k]
    out = np.full((horizon, levels.shape[1]), np.nan)
    out[:, ok] = std * sd[ok] + mu[ok]
    last, prev = P.last_two(levels.T)
    return P.level_rows(out.T, last, prev, codes).T, (s[:k] ** 2).sum() / (s**2).sum() * 100


def panel_for(make_panel, x, parts=3):
    return make_panel(columns(x), CODES, parts=parts)


def test_pca_var_matches_numpy(make_panel):
    x = np.abs(rand_panel(9, 60)) + 1
    codes = np.array([CODES[f"s{i}"] for i in range(9)])
    packed = factor.pack_levels(panel_for(make_panel, x))
    for order in (1, 2):
        spec = factor.FactorSpec(k=2, min_obs=30, horizon=4, order=order)
        expected, share = brute_pca_var(x, codes, 2, order, 4, 30)
        rows = factor.forecast_panel(packed, spec).orderBy("series", "h").collect()
        np.testing.assert_allclose(np.array([r.value for r in rows]).reshape(9, 4).T, expected, rtol=1e-7)
        assert factor.explained_variance(packed, spec).first().explained_pct == pytest.approx(share)


def test_rolling_windows_match_numpy(make_panel):
    x = np.abs(rand_panel(9, 30)) + 1
    codes = np.array([CODES[f"s{i}"] for i in range(9)])
    for horizon in (1, 3):
        spec = factor.FactorSpec(k=2, min_obs=15, horizon=horizon, window=20)
        rows = factor.rolling_forecast(factor.pack_levels(panel_for(make_panel, x)), spec).orderBy("origin", "series").collect()
        origins = sorted({r.origin for r in rows})
        assert origins == list(range(30 - 20 - horizon + 1))
        for o in origins:
            expected, _ = brute_pca_var(x[o : o + 20], codes, 2, 1, horizon, 15)
            got = np.array([np.nan if r.value is None else r.value for r in rows if r.origin == o])
            np.testing.assert_allclose(got, expected[-1], rtol=1e-6)
        first = next(r for r in rows if r.origin == 0)
        assert str(first.ds) == f"2001-{8 + horizon:02d}-01"


def test_scores_times_loadings_is_the_common_part(make_panel):
    x = np.abs(rand_panel(9, 60, missing=0)) + 1
    packed = factor.pack_levels(make_panel(columns(x)))
    spec = factor.FactorSpec(k=2, min_obs=30, horizon=1)
    models = factor.window_models(packed, spec)
    common = factor.map_factors(factor.factor_scores(models), factor.panel_loadings(packed, spec, models), "t")
    z, _, _ = P.scale_rows(x.T)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    expected = (u[:, :2] * s[:2]) @ vt[:2]
    got = np.array([r.common for r in common.orderBy("series", "t").collect()]).reshape(9, 60)
    np.testing.assert_allclose(got, expected, atol=1e-8)


def test_window_limit_and_too_few_series(make_panel):
    x = np.abs(rand_panel(2, 30, missing=0)) + 1
    spec = factor.FactorSpec(k=5, min_obs=10, horizon=1)
    rows = factor.forecast_panel(factor.pack_levels(make_panel(columns(x))), spec).collect()
    assert {r.status for r in rows} == {"too few series or periods"} and {r.value for r in rows} == {None}


def test_draws_do_not_depend_on_partitions(make_panel):
    x = np.abs(rand_panel(9, 60)) + 1
    spec = factor.FactorSpec(k=2, prepare="ready", dynamics="ar1", horizon=1)
    out = []
    for parts in (1, 7):
        packed = factor.pack_levels(panel_for(make_panel, x, parts)).repartition(parts)
        out.append(factor.draw_next(packed, spec, sims=200, seed=4).orderBy("series").collect())
    for a, b in zip(*out):
        assert (a.mean, a.p5, a.p95) == pytest.approx((b.mean, b.p5, b.p95), rel=1e-6)
        assert a.p5 <= a.mean <= a.p95


def test_draw_moments(make_panel):
    """With level codes the simulated mean is the factor forecast and the spread that of factors plus noise."""
    x = np.abs(rand_panel(8, 80, missing=0)) + 1
    spec = factor.FactorSpec(k=2, prepare="ready", dynamics="ar1", horizon=1)
    packed = factor.pack_levels(make_panel(columns(x)))
    got = np.array([(r.mean, r.sd) for r in factor.draw_next(packed, spec, sims=20000, seed=1).orderBy("series").collect()])
    z, mu, sd = P.scale_rows(x.T[:, 2:])
    u, s, vt = np.linalg.svd(z.T, full_matrices=False)
    f, load = u[:, :2] * s[:2], vt[:2].T
    c, phi, sigma = factor.factor_ar1_arrays(f)
    psi = np.maximum((z - load @ f.T).std(axis=1), 0.01)
    mean = (load @ (c + phi * f[-1])) * sd + mu
    spread = np.sqrt((load**2) @ sigma**2 + psi**2) * sd
    np.testing.assert_allclose(got[:, 1], spread, rtol=0.05)
    assert np.all(np.abs(got[:, 0] - mean) < 5 * spread / np.sqrt(20000))


def test_midpoint_percentile():
    v = np.array([[3.0, 1.0, 2.0, 4.0]])
    assert factor.midpoint_percentile(v, 0.5)[0] == 2.5
    assert factor.midpoint_percentile(v, 0.05)[0] == 1.0
    assert factor.midpoint_percentile(v, 0.30)[0] == pytest.approx(1.7)


# ------------------------------------------------------------- iterated models


def dfm_data(n=10, t=120, seed=8):
    rng = np.random.default_rng(seed)
    f = np.zeros(t)
    for i in range(1, t):
        f[i] = 0.8 * f[i - 1] + rng.normal()
    x = np.outer(f, rng.uniform(0.5, 1.5, n)) + 0.5 * rng.normal(size=(t, n)) + 20
    return f, x


def test_em_finds_the_factor_and_both_ways_agree(make_panel):
    f, x = dfm_data()
    x[5:9, 2] = np.nan
    x[-1, :3] = np.nan
    packed = factor.pack_levels(make_panel(columns(x)))
    spec = factor.FactorSpec(k=1, min_obs=50, horizon=2)
    inside = bayes.fit_dfm(packed, spec, iterations=3).orderBy("series").collect()
    outside = bayes.fit_dfm(packed, spec, iterations=3, max_cells=0).orderBy("series").collect()
    np.testing.assert_allclose([r.lam[0] for r in inside], [r.lam[0] for r in outside], rtol=1e-6)
    np.testing.assert_allclose([r.psi for r in inside], [r.psi for r in outside], rtol=1e-6)
    theta = bayes.fit_dfm(packed, spec, iterations=40).first().theta
    assert theta[0] == pytest.approx(0.8, abs=0.12)
    rows = bayes.dfm_forecast(packed, spec, iterations=10).orderBy("series", "h").collect()
    assert len(rows) == 20 and all(10 < r.value < 30 for r in rows)
    assert str(rows[0].ds) == "2010-01-01"


def test_em_with_two_factor_lags(make_panel):
    _, x = dfm_data()
    packed = factor.pack_levels(make_panel(columns(x)))
    spec = factor.FactorSpec(k=2, min_obs=50, horizon=3, order=2)
    inside = bayes.dfm_forecast(packed, spec, iterations=3).orderBy("series", "h").collect()
    outside = bayes.dfm_forecast(packed, spec, iterations=3, max_cells=0).orderBy("series", "h").collect()
    np.testing.assert_allclose([r.value for r in inside], [r.value for r in outside], rtol=1e-6)


def test_gibbs_posterior(make_panel):
    f, x = dfm_data()
    packed = factor.pack_levels(make_panel(columns(x)))
    spec = factor.FactorSpec(k=1, prepare="ready", dynamics="ar1", horizon=1)
    draws = bayes.gibbs(packed, spec, n_samples=200, n_tune=100, chains=2, seed=1)
    mean = bayes.posterior_factors(draws).orderBy("t").collect()
    assert abs(np.corrcoef([r.f for r in mean], f[2:])[0, 1]) > 0.95
    phi = bayes.posterior_means(draws.filter("param = 'Phi'")).first()
    assert phi.value == pytest.approx(0.8, abs=0.15) and phi.n_draws == 400
    out = bayes.predict(packed, spec, draws, horizon=2, sims=400, seed=1).collect()
    assert len(out) == 20 and all(r.p5 < r.mean < r.p95 for r in out)


def test_gibbs_draws_do_not_depend_on_where_they_are_made(make_panel):
    _, x = dfm_data(6, 40)
    packed = factor.pack_levels(make_panel(columns(x)))
    spec = factor.FactorSpec(k=1, prepare="ready", dynamics="ar1", horizon=1)
    key = lambda r: (r.param, r.draw, r.series or "", r.i, r.k)
    a, b = (sorted(bayes.gibbs(packed, spec, n_samples=3, n_tune=1, seed=1, max_cells=cells).collect(), key=key) for cells in (10**6, 0))
    assert [key(r) for r in a] == [key(r) for r in b]
    np.testing.assert_allclose([r.value for r in a], [r.value for r in b], rtol=1e-6, atol=1e-9)


def test_conditional_of_the_coefficient_uses_the_noise_variance():
    """Far from unit noise: the posterior of phi is that of a regression with known variance."""
    rng = np.random.default_rng(2)
    f = np.zeros((60, 2))
    for t in range(1, 60):
        f[t] = 0.7 * f[t - 1] + np.array([0.05, 9.0]) * rng.normal(size=2)
    sigma2 = np.array([0.05**2, 9.0**2])
    mean, variance = S.dynamics_posterior(f, sigma2)
    grid = np.linspace(-3, 3, 60001)
    for k in range(2):
        loglik = -((f[1:, k, None] - grid * f[:-1, k, None]) ** 2).sum(axis=0) / (2 * sigma2[k]) - grid**2 / 2
        w = np.exp(loglik - loglik.max())
        w /= w.sum()
        assert mean[k] == pytest.approx((w * grid).sum(), rel=1e-4)
        assert variance[k] == pytest.approx((w * grid**2).sum() - (w * grid).sum() ** 2, rel=1e-3)


def test_factor_paths_have_the_posterior_of_their_joint_normal():
    rng = np.random.default_rng(4)
    t, phi, sigma2 = 5, np.array([0.6, -0.3]), np.array([0.5, 2.0])
    z, lam, psi = rng.normal(size=(4, t)), rng.normal(size=(4, 2)), np.array([0.5, 1.0, 2.0, 1.5])
    prior = np.zeros((t * 2, t * 2))
    for k in range(2):
        lag = np.abs(np.subtract.outer(np.arange(t), np.arange(t)))
        prior[k::2, k::2] = sigma2[k] / (1 - phi[k] ** 2) * phi[k] ** lag
    load = np.kron(np.eye(t), lam)
    precision = np.linalg.inv(prior) + load.T @ np.diag(np.tile(1 / psi, t)) @ load
    mean = np.linalg.solve(precision, load.T @ (z.T.ravel() / np.tile(psi, t)))
    draws = np.array([S.sample_factors(S.information(z, lam, psi), phi, sigma2, rng).ravel() for _ in range(6000)])
    np.testing.assert_allclose(draws.mean(axis=0), mean, atol=0.06)
    np.testing.assert_allclose(np.cov(draws.T), np.linalg.inv(precision), atol=0.06)


def test_row_conditionals():
    rng = np.random.default_rng(5)
    f, z, psi = rng.normal(size=(30, 2)), rng.normal(size=(1, 30)), np.array([0.4])
    lam = np.array([S.sample_rows(z, psi, f, rng.standard_normal((1, 2)), np.array([20.0]))[0][0] for _ in range(6000)])
    precision = f.T @ f / 0.4 + np.eye(2)
    np.testing.assert_allclose(lam.mean(axis=0), np.linalg.solve(precision, f.T @ z[0] / 0.4), atol=0.01)
    np.testing.assert_allclose(np.cov(lam.T), np.linalg.inv(precision), atol=0.002)


def test_forecast_dates_of_hours_and_days(spark):
    """The periods after the last one, whatever the frequency."""
    import datetime

    from tidepanel.operators import univariate

    start = datetime.datetime(2020, 1, 1)
    for freq, step in (("hour", datetime.timedelta(hours=1)), ("day", datetime.timedelta(days=1))):
        kind = "timestamp" if freq == "hour" else "date"
        at = lambda i: start + i * step if freq == "hour" else (start + i * step).date()  # noqa: E731, B023
        rows = [("p", f"s{j}", at(i), i + 1, float((i * (j + 3)) % 11 + i), 61, 1) for j in range(5) for i in range(61)]
        panel = spark.createDataFrame(rows, f"panel_id string, series string, ds {kind}, t int, value double, n_periods int, tcode int")
        want = [at(61), at(62)]
        spec = factor.FactorSpec(k=1, freq=freq, horizon=2, min_obs=20)
        got = factor.forecast_panel(factor.pack_levels(panel, freq), spec).filter("series = 's0'").orderBy("h").collect()
        assert [r.ds for r in got] == want
        assert [r.ds for r in univariate.naive(panel, 2, freq=freq).filter("series = 's0'").orderBy("h").collect()] == want
        assert [r.ds for r in univariate.ar1_forecast(panel, 2, freq).filter("series = 's0'").orderBy("h").collect()] == want


def test_unknown_method(make_panel):
    packed = factor.pack_levels(make_panel({"a": [1.0, 2.0]}))
    with pytest.raises(ValueError, match="unknown method"):
        bayes.next_period(packed, factor.FactorSpec(), method="other")


def test_filling_keeps_observed_cells(make_panel):
    _, x = dfm_data(8, 40)
    holes = x.copy()
    holes[20, 1] = holes[25:27, 3] = holes[-2:, 5] = np.nan
    panel = make_panel(columns(holes))
    spec = factor.FactorSpec(k=1, prepare="ready", dynamics="ar1", horizon=1)
    filled = bayes.fill_gaps(factor.pack_levels(panel), spec, sims=50)
    assert sorted((r.series, t) for r in filled.collect() for t in r.filled) == [("s1", 21), ("s3", 26), ("s3", 27), ("s5", 39), ("s5", 40)]
    got = np.array([r.value for r in bayes.unpack_levels(filled).orderBy("series", "t").collect()], dtype=float).reshape(8, 40).T
    seen = ~np.isnan(holes)
    np.testing.assert_array_equal(got[seen], holes[seen])
    assert np.abs(got[~seen] - x[~seen]).max() < 3.5


def test_rolling_horizon_feeds_back(make_panel):
    _, x = dfm_data(8, 40)
    packed = factor.pack_levels(make_panel(columns(x)))
    spec = factor.FactorSpec(k=1, prepare="ready", dynamics="ar1", horizon=1)
    two = bayes.rolling_horizon(packed, spec, 2, sims=100, seed=2)
    first = {r.series: r for r in two.filter("h = 1").collect()}
    grown = np.vstack([x, [first[f"s{i}"].mean for i in range(8)]])
    again = factor.draw_next(factor.pack_levels(make_panel(columns(grown))), spec, sims=100, seed=2)
    expected = {r.series: r.mean for r in again.collect()}
    for r in two.filter("h = 2").collect():
        assert r["mean"] == pytest.approx(expected[r.series])
        assert str(r.ds) == "2003-06-01"


def test_quantiles_of_a_hot_series(spark):
    """One series holds nearly all draws, one all-equal draws, one a single draw; results equal numpy's."""
    from tidepanel.operators import predictive

    rng = np.random.default_rng(0)
    data = {"hot": rng.lognormal(sigma=4, size=60000).round(3), "flat": np.full(50, 2.5), "one": np.array([7.0]), "two": np.array([1.0, 2.0])}
    rows = [("p", k, float(v)) for k, values in data.items() for v in values] + [("p", "two", None)]
    draws = spark.createDataFrame(rows, "panel_id string, series string, value double")
    for r in predictive.interval(draws).collect():
        v = data[r.series]
        assert (r.n, r["mean"], r.p5, r.p95) == pytest.approx((len(v), v.mean(), *np.percentile(v, [5, 95])))
    for r in predictive.order_statistics(draws, [0.05, 0.5]).collect():
        v = data[r.series][None]
        assert "p5" in r.asDict() and (r.p5, r.p50) == pytest.approx((factor.midpoint_percentile(v, 0.05)[0], factor.midpoint_percentile(v, 0.5)[0]))
    assert {"p2", "p2_4"} <= set(predictive.order_statistics(draws, [0.02, 0.024]).columns)
