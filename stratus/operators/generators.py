"""Generators: columns that fill what is missing. ``filled`` chains them, the first one with a value wins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratus.functions.atmosphere import STEFAN_BOLTZMANN

#: Albedo of snow and of soil, snow height in m from which the ground is snow, emissivities, night threshold in W/m².
ALBEDO_SNOW, ALBEDO_SOIL, SNOW_HEIGHT = 0.85, 0.23, 0.1
EMISSIVITY_SNOW, EMISSIVITY_SOIL, NIGHT = 0.983, 0.9805, 4.0
DAY_US = 86_400_000_000


def filled(x: Column, *generators: Column) -> Column:
    return F.coalesce(x, *generators)


def daily_sinusoid(time: Column, low: float, high: float, phase: float = 0.0) -> Column:
    """Between ``low`` at midnight (phase 0) and ``high``; a Julian day begins at noon."""
    part = F.pmod(time + DAY_US // 2, F.lit(DAY_US)) / DAY_US
    return (high - low) / 2 * F.sin(2 * math.pi * (part - phase + 0.25)) + (high + low) / 2


def yearly_sinusoid(time: Column, low: float, high: float, phase: float = 0.0) -> Column:
    t = (F.dayofyear(F.timestamp_micros(time)) - phase * 365.25) / 366.25 - 0.25
    return (high - low) / 2 * F.sin(2 * math.pi * t) + (high + low) / 2


def surface_temperature(olwr: Column, hs: Column) -> Column:
    """From outgoing longwave radiation; without a snow height the mean emissivity of snow and soil holds."""
    e = F.when(hs.isNull(), (EMISSIVITY_SNOW + EMISSIVITY_SOIL) / 2).when(hs > SNOW_HEIGHT, EMISSIVITY_SNOW).otherwise(EMISSIVITY_SOIL)
    return F.pow(olwr / (e * STEFAN_BOLTZMANN), 0.25)


def albedo(hs: Column, force: bool = False) -> Column:
    return F.when(hs >= SNOW_HEIGHT, ALBEDO_SNOW).when(hs < SNOW_HEIGHT, ALBEDO_SOIL).otherwise(F.lit(0.5 if force else None))


def incoming_from_reflected(rswr: Column, hs: Column, force: bool = False) -> Column:
    return F.when(rswr <= NIGHT, rswr).otherwise(rswr / albedo(hs, force))


def reflected_from_incoming(iswr: Column, hs: Column, force: bool = False) -> Column:
    return F.when(iswr <= NIGHT, iswr).otherwise(iswr * albedo(hs, force))


def rain_fraction(ta: Column, low: float, high: float) -> Column:
    """0 below ``low``, 1 from ``high`` on, a line in between; equal bounds are a threshold."""
    if low == high:
        return F.when(ta >= high, 1.0).when(ta < high, 0.0)
    return F.when(ta.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ta - low) / (high - low))))


def split_precipitation(psum: Column, phase: Column, liquid: Column, solid: Column, model: Column) -> tuple[Column, Column, Column, Column]:
    """Sum, liquid fraction, liquid and solid precipitation, each from the others; ``model`` is a fraction for rows that have only the sum."""
    p, li, so = (F.when(c >= 0, c) for c in (psum, liquid, solid))
    f = F.when(phase.between(0, 1), phase)
    # greatest and least pass over nulls, so the share is tested first
    part = lambda a, b: F.when(a.isNotNull() & (b != 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), a / b)))
    total = F.coalesce(psum, li + so, li / F.nullif(f, F.lit(0.0)), F.when(li.isNull(), so / F.nullif(1 - f, F.lit(0.0))))
    fraction = F.coalesce(phase, F.when(psum == 0, 0.0), part(li, p), 1 - part(so, p), F.when(p.isNotNull() & li.isNull() & so.isNull(), model), F.when(p.isNull(), F.when(li + so == 0, 0.0).otherwise(part(li, li + so))))
    wet = F.coalesce(liquid, p * f, p - so, F.when(so.isNotNull() & p.isNull(), so * f / F.nullif(1 - f, F.lit(0.0))), F.when(so.isNull(), p * model))
    dry = F.coalesce(solid, p * (1 - f), p - li, F.when(li.isNotNull() & p.isNull(), li * (1 - f) / F.nullif(f, F.lit(0.0))), F.when(li.isNull(), p * (1 - model)))
    return total, fraction, wet, dry


def global_radiation(direct: Column, diffuse: Column) -> Column:
    return direct + diffuse
