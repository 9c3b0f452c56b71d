"""Inverse distances over all pairs: gaps, places shared by stations or cells, parts and shares, and many pairs in one region."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratus.operators import spatial as sp


def _plain(ce, st):
    """Each cell with all stations of its region, row by row."""
    out = {}
    for g, c, x, y, _ in ce:
        valued = [s for s in st if s[0] == g and s[5] is not None]
        near = [s for s in valued if None not in (x, y, s[2], s[3])]
        w = [1 / ((x - s[2]) ** 2 + (y - s[3]) ** 2 + 1e6) ** 0.5 for s in near]
        if valued and g is not None:
            out[g, c] = sum(a * s[5] for a, s in zip(w, near, strict=True)) / sum(w) if near else None
    return out


@pytest.mark.parametrize(("stations", "cells"), [(65_536, 32_768), (2, 3)])
def test_gaps_and_shared_places(spark, monkeypatch, stations, cells):
    monkeypatch.setattr(sp, "STATIONS", stations)
    monkeypatch.setattr(sp, "CELLS", cells)
    st = [(1, k, 100.0 * (k % 4), 50.0 * (k % 2), 9.0 * k, float(k)) for k in range(12)] + [(1, 20, None, 3.0, 0.0, 5.0), (1, 21, 3.0, 3.0, 0.0, None)]
    st += [(2, 1, None, 1.0, 2.0, 3.0), (3, 1, 1.0, 1.0, 1.0, None), (None, 1, 1.0, 1.0, 1.0, 1.0)]
    ce = [(g, k, 70.0 * (k % 3), 20.0, float(k)) for g in (1, 2, 3, 4, None) for k in range(8)] + [(1, 9, None, 1.0, 1.0), (1, 10, 1.0, None, 1.0), (1, 2**60 + 1, 4.0, 4.0, None)]
    df = spark.createDataFrame(ce, "region int, cell long, x double, y double, alt double"), spark.createDataFrame(st, "region int, station int, x double, y double, alt double, value double")
    assert {(r.region, r.cell): r.value for r in sp.idw(*df).collect()} == pytest.approx(_plain(ce, st), nan_ok=False)
    lapse = {(r.region, r.cell): r.value for r in sp.idw_lapse(*df).collect()}
    assert lapse[1, 2**60 + 1] is None and set(lapse) == set(_plain(ce, st))


def test_a_region_with_very_many_pairs(spark):
    """1.6 thousand million pairs, no row for each."""
    at = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), 1_000_003) / 10.0).alias("xyv"[k])
    ce = spark.range(40_000).select(F.lit(1).alias("region"), F.col("id").alias("cell"), at(0), at(1), F.lit(0.0).alias("alt"))
    st = spark.range(100_000, 140_000).select(F.lit(1).alias("region"), F.col("id").alias("station"), at(0), at(1), F.lit(0.0).alias("alt"), at(2)).withColumnRenamed("v", "value")
    began = time.time()
    got = sp.idw(ce, st).toPandas().set_index("cell")["value"]
    assert time.time() - began < 60 and len(got) == 40_000
    s = st.toPandas()
    for r in ce.where("id % 9973 = 0").collect():
        w = 1 / np.sqrt((r.x - s.x) ** 2 + (r.y - s.y) ** 2 + 1e6)
        assert got[r.cell] == pytest.approx((w * s.value).sum() / w.sum(), rel=1e-12)
