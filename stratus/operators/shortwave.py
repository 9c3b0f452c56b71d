"""Shortwave radiation under a clear sky: what generators, the potential filter and the solar resampling rest on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.functions import radiation, sun
from stratus.functions.atmosphere import STEFAN_BOLTZMANN, clear_sky_longwave, std_pressure
from stratus.operators import resampling
from stratus.operators.generators import albedo as snow_albedo

#: Air that has an average amount of water, and radiation in W/m² from which a ratio to it counts.
MEAN_TA, MEAN_RH, FAINT = 274.98, 0.666, 4.0


class Place(NamedTuple):
    """Degrees and metres, as columns."""

    lat: Column
    lon: Column
    alt: Column


def with_potential(df: DataFrame, name: str, t: Column, place: Place, ta: Column | None = None, rh: Column | None = None, pressure: Column | None = None, albedo: Column | float = 0.5) -> DataFrame:
    """``df`` with the column ``name`` of (top, ground): radiation on the horizontal above the atmosphere and at the ground.

    Without temperature or humidity the air is average, without pressure standard.
    """
    s = sun.sun(t, place.lat, place.lon)
    # the sun first, as a column that the long formulas only name
    df = df.withColumns({"el_": s.elevation, "ecc_": s.eccentricity})
    el, none = F.col("el_"), F.lit(None).cast("double")
    ta, rh, pressure = (none if c is None else c for c in (ta, rh, pressure))
    known = ta.isNotNull() & rh.isNotNull()
    df = df.withColumns({"toa_": F.when(el < 0, 0.0).otherwise(radiation.SOLAR_CONSTANT * (1 + F.col("ecc_"))), "ta_": F.when(known, ta).otherwise(MEAN_TA), "rh_": F.when(known, rh).otherwise(MEAN_RH), "p_": F.coalesce(pressure, std_pressure(place.alt))})
    df = df.withColumn("sky_", radiation.clear_sky(el, F.col("toa_"), F.col("ta_"), F.col("rh_"), F.col("p_"), F.lit(albedo) if isinstance(albedo, float) else albedo, place.alt))
    both = F.struct(radiation.on_horizontal(F.col("toa_"), el).alias("top"), (radiation.on_horizontal(F.col("sky_.direct"), el) + F.col("sky_.diffuse")).alias("ground"))
    return df.withColumn(name, both).drop("el_", "ecc_", "toa_", "ta_", "rh_", "p_", "sky_")


def ground_albedo(iswr: Column, rswr: Column, hs: Column) -> Column:
    """From both radiations if they are there and above 0, else of snow or soil; 0.5 where neither is known."""
    both = iswr.isNotNull() & rswr.isNotNull()
    return F.when(both & (iswr > 0) & (rswr > 0), F.greatest(F.lit(0.01), F.least(F.lit(0.99), rswr / iswr))).when(both, 0.5).otherwise(snow_albedo(hs, force=True))


def clearness_of_longwave(ta: Column, rh: Column, ilwr: Column) -> Column:
    """Share of the clear sky's radiation under the clouds that incoming longwave radiation tells of."""
    black = STEFAN_BOLTZMANN * F.pow(ta, 4)
    clear = clear_sky_longwave("DILLEY", rh, ta) / black
    clouds = (ilwr / black - clear) / (0.84 * (1 - clear))
    return sun.clearness(F.greatest(F.lit(0.0), F.least(F.lit(1.0), clouds)))


def all_sky_index(ta: Column, rh: Column, ilwr: Column, tau: Column) -> Column:
    """Transmissivity if it is known, else from longwave radiation, else 1."""
    return F.coalesce(tau, F.when(ta.isNotNull() & rh.isNotNull(), clearness_of_longwave(ta, rh, ilwr)), F.lit(1.0))


def potential_filter(x: Column, limits: Column, low: float = 0.03, high: float = 1.1, soft: bool = False, ground: bool = False, albedo: Column | None = None) -> Column:
    """Null (or the limit, if soft) under ``low`` times the radiation above the atmosphere (or at the ground) and over ``high`` times that at the ground.

    ``limits`` is a column of :func:`with_potential`; reflected radiation is divided by its ``albedo`` first.
    """
    a = F.lit(1.0) if albedo is None else albedo
    under, floor, over = limits["top"] * low, limits["ground"] * low, limits["ground"] * high
    out = F.when(x.isNull(), x)
    if not ground:
        out = out.when(x / a < under, under * a if soft else None)
    return out.when(x / a < floor, floor * a if soft else None).when(x / a > over, over * a if soft else None).otherwise(x)


def resample_solar(obs: DataFrame, asked: DataFrame, station: str, time: str, value: str, places: DataFrame, window: int = resampling.WINDOW, extrapolate: bool = False) -> DataFrame:
    """Radiation at the times of ``asked``: the potential there times the loss between the values around it.

    ``places`` has the station and lat, lon, alt. The loss of a value is its ratio to the potential, none where that is faint; it
    changes linearly from one value to the next, and is 1 where neither has one. The air is average.
    """
    us = window * 1_000_000
    seen = resampling._around(obs, asked, station, time, value, us).join(places, station)
    t, place = F.col(time), Place(F.col("lat"), F.col("lon"), F.col("alt"))
    p1, p2 = resampling._within(F.col("p1"), F.col("p2"), t, us)
    seen = seen.withColumns({"a": p1, "b": p2})
    for name, when in (("pot", t), ("pot1", F.col("a.t")), ("pot2", F.col("b.t"))):
        seen = with_potential(seen, name, when, place).withColumn(name, F.col(f"{name}.ground"))
    loss = lambda p: F.when(F.col(f"pot{p}") > FAINT, F.col("ab"[p - 1])["x"] / F.col(f"pot{p}"))
    weight = (t - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    between = loss(1) * (1 - weight) + loss(2) * weight
    both, some = F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a").isNotNull() | F.col("b").isNotNull()
    inside = some if extrapolate else both & t.between(F.col("first"), F.col("last"))
    return seen.select(station, time, F.when(F.col("b.t") == t, F.col("b.x")).when(inside, F.coalesce(between, loss(1), loss(2), F.lit(1.0)) * F.col("pot")).alias(value))
