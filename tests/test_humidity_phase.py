"""Humidity by dew points and the phase of precipitation on a few cells."""

import pytest

from stratus.operators import spatial as sp


def test_one_station_keeps_its_humidity_at_its_temperature(spark):
    cells = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 283.15), (1, 2, 5.0, 0.0, 9.0, 278.15), (1, 3, 5.0, 0.0, 9.0, None)], "region int, cell int, x double, y double, alt double, ta double")
    rows = [(1, 1, 3.0, 0.0, 9.0, 0.5, 283.15), (1, 2, 3.0, 0.0, 9.0, None, 283.15), (1, 3, 3.0, 0.0, 9.0, 1.5, 283.15), (1, 4, 3.0, 0.0, 9.0, 0.9, None)]
    stations = spark.createDataFrame(rows, "region int, station int, x double, y double, alt double, rh double, ta double")
    got = {r.cell: r.value for r in sp.humidity_by_dew_point(cells, stations).collect()}
    assert got[1] == pytest.approx(0.5, abs=2e-4)
    assert got[1] < got[2] < 1 and got[3] is None


def test_phase_at_and_beyond_the_thresholds(spark):
    field = spark.createDataFrame([(1, k, v) for k, v in enumerate([270.0, 272.15, 273.15, 274.15, 280.0, None])], "region int, cell int, value double")
    values = lambda df: [r.value for r in df.orderBy("cell").collect()]
    assert values(sp.precipitation_phase(field, 273.15)) == [0.0, 0.0, 1.0, 1.0, 1.0, None]
    assert values(sp.precipitation_phase(field, 274.15, 272.15)) == pytest.approx([0.0, 0.0, 0.5, 1.0, 1.0, None])
    with pytest.raises(ValueError):
        sp.precipitation_phase(field, 273.15, 273.15)
