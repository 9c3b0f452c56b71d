"""Shortwave radiation: known magnitudes, and losses that hold between measurements."""

import pytest
from pyspark.sql import functions as F

from stratus.functions import radiation
from stratus.operators import shortwave as sw

HOUR = 3_600_000_000


def test_clear_sky_has_the_usual_magnitudes(spark):
    df = spark.createDataFrame([(60.0,), (10.0,), (3.0,), (-1.0,), (None,)], "e double")
    sky = radiation.clear_sky(F.col("e"), F.when(F.col("e") >= 0, 1366.1).otherwise(0.0), F.lit(280.0), F.lit(0.5), F.lit(101_325.0), F.lit(0.2), F.lit(0.0))
    high, low, dawn, night, unknown = (r.s for r in df.select(sky.alias("s")).collect())
    assert 800 < high.direct < 1000 and 50 < high.diffuse < 150
    assert 200 < low.direct < 600 and low.diffuse < high.diffuse
    assert dawn.direct == 0 and dawn.diffuse > 0 and tuple(night) == (0, 0) and unknown.direct is None


def test_projections_and_splitting(spark):
    one = spark.range(1)
    f = lambda c: one.select(c.cast("double")).first()[0]
    lit = lambda v: F.lit(float(v))
    assert f(radiation.on_horizontal(lit(1000), lit(30))) == pytest.approx(500)
    assert f(radiation.on_slope(lit(1000), lit(30), lit(180), lit(60), lit(180))) == pytest.approx(1000)
    assert f(radiation.on_slope(lit(1000), lit(30), lit(180), lit(60), lit(0))) == 0
    assert [f(radiation.diffuse_share(lit(m), lit(1000), lit(45))) for m in (900, 100)] == [0.147, pytest.approx(0.9952)]
    assert f(radiation.diffuse_share(lit(100), lit(1000), lit(4))) == 1


def test_loss_holds_between_values(spark):
    places = spark.createDataFrame([(1, 46.8, 9.8, 1560.0)], "s long, lat double, lon double, alt double")
    day = 1_718_841_600_000_000
    times = spark.createDataFrame([(1, day + k * HOUR // 2) for k in range(48)], "s long, t long").join(places, "s")
    times = sw.with_potential(times, "p", F.col("t"), sw.Place(F.col("lat"), F.col("lon"), F.col("alt"))).select("s", "t", F.col("p.ground").alias("p"))
    obs = times.where(F.col("t") % HOUR == 0).select("s", "t", F.when(F.col("t") != day + 12 * HOUR, F.col("p") * 0.7).alias("x"))
    got = {r.t: r.x for r in sw.resample_solar(obs, times.select("s", "t"), "s", "t", "x", places).collect()}
    want = {r.t: r.p for r in times.collect()}
    bright = [t for t, p in want.items() if p > 50 and t <= day + 23 * HOUR]
    assert len(bright) > 20 and all(got[t] == pytest.approx(0.7 * want[t], abs=1e-6) for t in bright)
    assert got[day + 47 * HOUR // 2] is None
