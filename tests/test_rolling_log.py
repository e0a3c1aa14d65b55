"""Rolling forecasts: outcomes of steps, restart from a step log, dates of days and hours."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import bayes, factor

SPEC = factor.FactorSpec(k=1, prepare="ready", dynamics="ar1", horizon=1)


def packed(make_panel, n=5, t=40):
    rng = np.random.default_rng(2)
    f = np.cumsum(rng.normal(size=t))
    cols = {f"s{i}": (10 + (i + 1) * f + rng.normal(size=t)).tolist() for i in range(n)}
    cols["rare"] = [1.0, 2.0] + [None] * (t - 2)
    return factor.pack_levels(make_panel(cols))


def rows(df):
    return {(r.h, r.series): (r["mean"], r.p5, r.p95, r.status, str(r.ds)) for r in df.collect()}


def test_a_cut_run_goes_on(make_panel, tmp_path, monkeypatch):
    table = packed(make_panel)
    whole = rows(bayes.rolling_horizon(table, SPEC, 3, sims=50, seed=1))
    assert {v[3] for k, v in whole.items() if k[1] != "rare"} == {"ok"} and whole[1, "rare"][3] == "not usable"
    assert whole[3, "s0"][4] == "2003-07-01"
    made, plain = [], bayes.next_period

    def counted(history, spec, **options):
        made.append(len(history.first()["v"]))
        return plain(history, spec, **options)

    monkeypatch.setattr(bayes, "next_period", counted)
    first = rows(bayes.rolling_horizon(table, SPEC, 2, str(tmp_path / "run"), sims=50, seed=1))
    assert made == [40, 41]
    again = rows(bayes.rolling_horizon(table, SPEC, 3, str(tmp_path / "run"), sims=50, seed=1))
    assert made == [40, 41, 42]
    assert again == whole and first == {k: v for k, v in whole.items() if k[0] < 3}


def test_a_failed_step_is_null_rows_with_its_reason(make_panel, monkeypatch):
    table, plain = packed(make_panel), bayes.next_period

    def broken(history, spec, **options):
        out = plain(history, spec, **options)
        if len(history.first()["v"]) == 41:
            out = out.withColumn("mean", F.raise_error(F.lit("no memory left")).cast("double"))
        return out

    monkeypatch.setattr(bayes, "next_period", broken)
    got = rows(bayes.rolling_horizon(table, SPEC, 3, sims=50, seed=1))
    assert all("no memory left" in v[3] and v[:3] == (None, None, None) for k, v in got.items() if k[0] == 2)
    assert got[1, "s0"][3] == got[3, "s0"][3] == "ok" and got[3, "s0"][4] == "2003-07-01"


@pytest.mark.parametrize("method", ["bayesian", "bayesian-ar"])
def test_other_methods(make_panel, tmp_path, method):
    out = bayes.rolling_horizon(packed(make_panel), SPEC, 2, str(tmp_path), method=method, sims=50, n_samples=20, n_tune=10, seed=1)
    got = rows(out)
    assert all(v[1] < v[0] < v[2] for k, v in got.items() if k[1] != "rare") and len(got) == 12


def test_unknown_method_is_an_error_and_not_an_outcome(make_panel):
    with pytest.raises(ValueError):
        bayes.rolling_horizon(packed(make_panel), SPEC, 1, method="other")


@pytest.mark.parametrize("freq,first,after", [("day", datetime.date(2024, 1, 1), "2024-02-10"), ("hour", datetime.datetime(2024, 1, 1, 5), "2024-01-02 21:00:00")])
def test_dates_of_days_and_hours(make_panel, freq, first, after):
    kind = "timestamp" if freq == "hour" else "date"
    table = packed(make_panel).withColumn("first_ds", F.lit(first).cast(kind))
    spec = factor.FactorSpec(k=1, prepare="ready", dynamics="ar1", horizon=1, freq=freq)
    got = rows(bayes.rolling_horizon(table, spec, 1, sims=20, seed=1))
    assert got[1, "s0"][4] == after
    dfm = factor.FactorSpec(k=1, min_obs=20, horizon=2, freq=freq)
    forecast = bayes.dfm_forecast(table, dfm, iterations=3).filter("h = 1").first()
    assert str(forecast.ds) == after
    levels = bayes.unpack_levels(table, freq=freq).filter("t = 40 and series = 's0'").first()
    step = datetime.timedelta(days=39) if freq == "day" else datetime.timedelta(hours=39)
    assert levels.ds == first + step
