"""Leading vectors of whole panels against a singular value decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import factor, subspace


def table(spark, panels, parts=4):
    rows = [(name, f"s{i}", True, z[:, i].tolist(), [True] * len(z)) for name, z in panels.items() for i in range(z.shape[1])]
    return spark.createDataFrame(rows, "panel_id string, series string, usable boolean, z array<double>, seen array<boolean>").repartition(parts)


def data(t, n, seed, rank=3, noise=0.5):
    rng = np.random.default_rng(seed)
    f = np.cumsum(rng.normal(size=(t, rank)), axis=0)
    return f @ rng.normal(size=(rank, n)) + noise * rng.normal(size=(t, n))


def test_same_as_svd(spark):
    rng = np.random.default_rng(4)
    panels = {
        "short": data(9, 30, 1), "months": data(90, 40, 2), "noise": rng.normal(size=(150, 60)), "long": data(5000, 12, 3), "one": data(40, 1, 4),
    }
    got = {r["panel_id"]: r for r in subspace.leading(table(spark, panels), 3).collect()}
    for name, z in panels.items():
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        r = got[name]
        k = min(3, len(s))
        np.testing.assert_allclose(np.sqrt(r["found"][:k]), s[:k], rtol=1e-8)
        vectors = np.array(r["vectors"]).reshape(-1, len(z))[:k]
        np.testing.assert_allclose(np.abs((vectors * u[:, :k].T).sum(axis=1)), 1, atol=1e-8)
        assert r["residual"] < 1e-9 and r["n_series"] == z.shape[1] and r["total"] == pytest.approx((z**2).sum())


def test_does_not_depend_on_buckets(spark, monkeypatch):
    panels = {"a": data(120, 50, 5)}
    results = []
    for number, whole in ((1, 128), (3, 20), (60, 20)):
        monkeypatch.setattr(subspace.bucketed, "__defaults__", (number,))
        monkeypatch.setattr(subspace, "WHOLE", whole)
        results.append(np.array(subspace.leading(table(spark, panels), 2).first()["vectors"]))
    for other in results[1:]:
        np.testing.assert_allclose(np.abs(results[0]), np.abs(other), atol=1e-8)


def test_series_that_are_not_usable_and_no_series(spark):
    rows = [("p", "a", False, None, [True, False, True]), ("p", "b", True, [1.0, -1.0, 0.0], [True, True, False])]
    z = spark.createDataFrame(rows, "panel_id string, series string, usable boolean, z array<double>, seen array<boolean>")
    r = subspace.leading(z, 1).first()
    assert r["n_series"] == 1 and r["counts"] == [2.0, 1.0, 1.0] and r["found"][0] == pytest.approx(2.0)
    none = subspace.leading(z.withColumn("usable", F.lit(False)).withColumn("z", F.lit(None).cast("array<double>")), 1).first()
    assert none["n_series"] == 0 and none["found"] == [0.0]
    assert subspace.leading(z.limit(0), 1).count() == 0


def test_a_calendar_beyond_any_window(spark):
    """Six series of 4,500 hours through the whole factor forecast."""
    z = data(4500, 6, 6, rank=2)
    rows = spark.createDataFrame([("h", f"s{i}", 1, np.datetime64("2020-01-01T00").item(), z[:, i].tolist()) for i in range(6)], "panel_id string, series string, tcode int, first_ds timestamp, v array<double>")
    spec = factor.FactorSpec(k=2, horizon=3, freq="hour")
    out = factor.forecast_panel(rows, spec).orderBy("series", "h").collect()
    scale = (z - z.mean(axis=0)) / z.std(axis=0, ddof=1)
    u, s, vt = np.linalg.svd(scale, full_matrices=False)
    f = u[:, :2] * s[:2]
    design = np.column_stack([np.ones(len(f) - 1), f[:-1]])
    coef = np.linalg.lstsq(design, f[1:], rcond=None)[0]
    step, path = f[-1], []
    for _ in range(3):
        step = np.concatenate([[1.0], step]) @ coef
        path.append(step)
    expected = (np.array(path) @ vt[:2]) * z.std(axis=0, ddof=1) + z.mean(axis=0)
    np.testing.assert_allclose(np.array([r.value for r in out]).reshape(6, 3), expected.T, rtol=1e-6)
    assert str(out[0].ds) == "2020-07-06 12:00:00"
