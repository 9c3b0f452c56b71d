"""Variogram fits against models that made the points, kriged fields against a plain solution for each cell."""

import numpy as np
import pytest

from stratus.operators import kriging as kg


@pytest.mark.parametrize(("model", "p"), [("LINVARIO", [3.0, 0.25]), ("SPHERICVARIO", [1.0, 6.0, 14.0]), ("EXPVARIO", [0.5, 4.0, 2.0]), ("RATQUADVARIO", [0.5, 2.0, 3.0])])
def test_fit_finds_the_model(model, p):
    d = np.linspace(0.5, 20.0, 30)
    assert kg.fit(model, d, kg.VARIOGRAMS[model].of(d, p)) == pytest.approx(p, rel=1e-4)


def test_fit_gives_up():
    d = np.linspace(1000.0, 9000.0, 20)
    assert kg.fit("EXPVARIO", d, d) is None  # flat at the first guess of one metre
    assert kg.fit("LINVARIO", d[:2], d[:2]) is None
    assert kg.fit("LINVARIO", np.full(5, 3.0), np.arange(5.0)) is None


def test_bins_hold_equal_counts():
    d = np.arange(43.0)[::-1]
    x, y = kg.binned(d, 2 * d)
    assert len(x) == 10 and list(y) == list(2 * x)
    assert list(x[:4]) == [2.0, 7.0, 12.0, 16.5]
    assert len(kg.binned(d[:40], d[:40])[0]) == 40


def _stations():
    rng = np.random.default_rng(5)
    return [(1, k, float(a), float(b), float(c), float(v)) for k, (a, b, c, v) in enumerate(zip(rng.uniform(0, 30, 25), rng.uniform(0, 30, 25), rng.uniform(0, 900, 25), rng.uniform(1, 9, 25)))]


SCHEMA = "region int, station int, x double, y double, alt double, value double"


@pytest.mark.parametrize("model", ["LINVARIO", "SPHERICVARIO", "RATQUADVARIO"])
def test_cells_equal_a_system_for_each(spark, model):
    rows = _stations()
    cells = [(1, k, 1.7 * k, 29.0 - 2.1 * k, 0.0) for k in range(12)] + [(1, 99, rows[0][2], rows[0][3], 0.0)]
    st = spark.createDataFrame(rows, SCHEMA)
    got = {r.cell: r.value for r in kg.kriging(spark.createDataFrame(cells, "region int, cell int, x double, y double, alt double"), st, [model]).collect()}
    f = kg.kriging_fits(st, [model]).first()
    p, kind = [f.a, f.b, f.c], kg.VARIOGRAMS[f.model]
    x, y, z = (np.array([r[k] for r in rows]) for k in (2, 3, 5))
    n = len(z)
    gamma = lambda d: np.where(d == 0, 0.0, kind.of(d, p))
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = gamma(np.hypot(x[:, None] - x, y[:, None] - y))
    np.fill_diagonal(system, [1.0] * n + [0.0])
    for _, cell, cx, cy, _ in cells:
        share = np.linalg.solve(system, np.append(gamma(np.hypot(x - cx, y - cy)), 1.0))
        assert share[:n].sum() == pytest.approx(1.0)
        assert got[cell] == pytest.approx(share[:n] @ z)


def test_few_stations_and_none(spark):
    rows = [(1, 1, 0.0, 0.0, 0.0, 4.0), (2, 1, 0.0, 0.0, 0.0, 0.0), (2, 2, 5.0, 0.0, 0.0, 0.0), (3, 1, 0.0, 0.0, 0.0, 1.0), (3, 2, 5.0, 0.0, 0.0, 2.0), (4, 1, 0.0, 0.0, 0.0, None), (1, 2, None, 0.0, 0.0, 9.0)]
    cells = spark.createDataFrame([(k, k, 1.0, 1.0, 0.0) for k in range(1, 6)], "region int, cell int, x double, y double, alt double")
    got = {r.cell: r.value for r in kg.kriging(cells, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 4.0, 2: 0.0, 3: None, 4: None, 5: None}


def test_a_trend_alone_comes_back(spark):
    rows = [(r, s, x, y, a, 20.0 - 0.01 * a) for r, s, x, y, a, _ in _stations()]
    cells = spark.createDataFrame([(1, 1, 3.0, 4.0, 1500.0)], "region int, cell int, x double, y double, alt double")
    assert kg.kriging_lapse(cells, spark.createDataFrame(rows, SCHEMA)).first().value == pytest.approx(5.0, abs=1e-6)


def test_too_many_stations_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(kg, "MOST", 24)
    with pytest.raises(ValueError, match="25 stations"):
        kg.kriging_fits(spark.createDataFrame(_stations(), SCHEMA))
