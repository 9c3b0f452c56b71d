"""Neighbours over tiles against all pairs: crowds, lines, one place, cells far outside, ties, gaps in any column."""

import random

import pytest

from stratus.operators import spatial as sp
from stratus.operators.neighbours import closest

CELLS = "region int, cell int, x double, y double, alt double"
STATIONS = "region int, station int, x double, y double, alt double, value double"


def _layouts():
    r = random.Random(4)
    u = lambda: r.uniform(0, 1000)
    st = [(0, s, u(), u(), 1.0, float(s)) for s in range(300)]  # spread
    st += [(1, s, 1e-3 * u(), 1e-3 * u(), 1.0, float(s)) for s in range(200)] + [(1, 999, 1000.0, 900.0, 1.0, 9.0)]  # a crowd and one far off
    st += [(2, s, u(), 5.0, 1.0, float(s)) for s in range(50)]  # a line
    st += [(3, s, 7.0, 7.0, 1.0, float(s)) for s in range(40)]  # one place
    st += [(4, s, float(s % 10), float(s // 10), 1.0, float(s)) for s in range(100)]  # a lattice, all ties
    st += [(5, 1, 3.0, 3.0, 1.0, None), (5, 2, None, 3.0, 1.0, 2.0), (5, 3, 900.0, 900.0, 1.0, 3.0)]
    ce = [(g, c, u(), u(), 0.0) for g in range(7) for c in range(80)] + [(g, 100 + c, 40_000 * r.uniform(-1, 1), u(), 0.0) for g in range(7) for c in range(10)]
    ce += [(4, 200 + c, c % 7 + 0.5, c // 7 + 0.5, 0.0) for c in range(49)] + [(0, 300, None, 1.0, 0.0), (3, 301, 7.0, 7.0, None)]
    return ce, st


def _all_pairs(ce, st, k, most, last):
    out = {}
    for g, c, x, y, _ in ce:
        if x is None or y is None:
            continue
        near = sorted(((x - s[2]) ** 2 + (y - s[3]) ** 2, -s[1] if last else s[1]) for s in st if s[0] == g and s[5] is not None and s[2] is not None)
        near = [abs(s) for d, s in near[:k] if most is None or d <= most * most]
        if near:
            out[g, c] = near
    return out


@pytest.mark.parametrize(("k", "most", "last"), [(1, None, True), (4, None, False), (3, 120.0, False)])
def test_closest_equals_all_pairs(spark, k, most, last):
    ce, st = _layouts()
    got = {}
    for x in closest(spark.createDataFrame(ce, CELLS), spark.createDataFrame(st, STATIONS), k, most, last).collect():
        got.setdefault((x.region, x.cell), []).append((x.place, x.station))
    assert {c: [s for _, s in sorted(v)] for c, v in got.items()} == _all_pairs(ce, st, k, most, last)


def test_no_rows(spark):
    none, st = spark.createDataFrame([], CELLS), spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 2.0)], STATIONS)
    assert sp.nearest(none, st).collect() == []
    assert sp.nearest(spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0)], CELLS), st.limit(0)).collect() == []


def test_many_stations_are_met_in_shares(spark, monkeypatch):
    """Full inverse distances are the same with and without a broadcast."""
    ce, st = _layouts()
    ce, st = spark.createDataFrame(ce, CELLS), spark.createDataFrame(st, STATIONS)
    few = {(x.region, x.cell): x.value for x in sp.idw(ce, st).collect()}
    monkeypatch.setattr(sp, "STATIONS", 10)
    assert {(x.region, x.cell): x.value for x in sp.idw(ce, st).collect()} == pytest.approx(few, nan_ok=True)
