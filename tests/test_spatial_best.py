"""Regions with 0, 1, 2 and 3 stations."""

import pytest

from stratus.operators import spatial as sp
from stratus.queries import QUERIES


def test_all_stations_are_interpolated():
    assert "spatial_best_all" in QUERIES


def test_each_number_of_stations(spark):
    cells = spark.createDataFrame([(n, n, 0.0, 0.0, 300.0) for n in range(4)], "region int, cell int, x double, y double, alt double")
    rows = [(n, 10 * n + k, 100.0 * k, 0.0, 100.0 * k, 20.0 - k) for n in range(4) for k in range(n)]
    stations = spark.createDataFrame(rows, "region int, station int, x double, y double, alt double, value double")
    got = {r.region: (r.algorithm, r.value) for r in sp.interpolate(cells, stations, ["AVG_LAPSE", "AVG", "IDW_LAPSE", "CST"], 7.0, (-500.0, 9000.0)).collect()}
    # the trend is -1 in 100 metres of altitude
    assert got == {0: ("CST", 7.0), 1: ("AVG", 20.0), 2: ("AVG_LAPSE", pytest.approx(17.0)), 3: ("IDW_LAPSE", pytest.approx(17.0))}
