"""Position of the sun and what follows from it as column expressions, by the usual low-accuracy series (Meeus).

Times are microseconds of UTC, latitudes and longitudes degrees (north and east positive); null in gives null out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radiation above the atmosphere in W/m², factor and exponent of clearness against cloudiness.
SOLAR_CONSTANT = 1366.1
CLOUD_FACTOR, CLOUD_POWER = 0.75, 3.4


class Sun(NamedTuple):
    """Degrees: declination, height over the horizon, bearing from north; minutes: equation of time; orbit's eccentricity."""

    declination: Column
    elevation: Column
    azimuth: Column
    equation: Column
    eccentricity: Column


def sun(t_us: Column, lat: Column, lon: Column) -> Sun:
    rad = F.radians
    century = (t_us / 86_400_000_000 - 10_957.5) / 36_525
    long = 280.46646 + century * (36_000.76983 + century * 0.0003032)
    anomaly = 357.52911 + century * (35_999.05029 - century * 0.0001537)
    ecc = 0.016708634 - century * (0.000042037 + century * 0.0000001267)
    centre = F.sin(rad(anomaly)) * (1.914602 - century * (0.004817 + century * 0.000014)) + F.sin(rad(2 * anomaly)) * (0.019993 - century * 0.000101) + F.sin(rad(3 * anomaly)) * 0.000289
    node = rad(125.04 - 1934.136 * century)
    apparent = rad(long + centre - 0.00569 - 0.00478 * F.sin(node))
    tilt = rad(23.439291 - century * (0.0130042 + century * (1.64e-7 - century * 5.04e-7)) + 0.00256 * F.cos(node))
    decl = F.asin(F.sin(tilt) * F.sin(apparent))
    y, m, two = F.pow(F.tan(tilt / 2), 2), rad(anomaly), rad(2 * long)
    equation = 4 * F.degrees(y * F.sin(two) - 2 * ecc * F.sin(m) + 4 * ecc * y * F.sin(m) * F.cos(two) - y * y * F.sin(2 * two) / 2 - 1.25 * ecc * ecc * F.sin(2 * m))
    minutes = F.pmod(t_us, F.lit(86_400_000_000)) / 60_000_000
    hour = rad(F.pmod(minutes + equation + 4 * lon, F.lit(1440.0)) / 4 - 180)
    phi = rad(lat)
    height = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(hour))))
    known = t_us.isNotNull() & lat.isNotNull() & lon.isNotNull()
    bearing = F.pmod(F.degrees(F.atan2(F.sin(hour), F.cos(hour) * F.sin(phi) - F.tan(decl) * F.cos(phi))) + 180, F.lit(360.0))
    return Sun(F.degrees(decl), F.when(known, F.degrees(height)), bearing, equation, ecc)


def top_radiation(s: Sun) -> Column:
    """Radiation on a horizontal plane above the atmosphere, 0 while the sun is below the horizon; the beam is the constant times 1 + eccentricity."""
    beam = SOLAR_CONSTANT * (1 + s.eccentricity)
    return F.when(s.elevation < 0, 0.0).when(s.elevation >= 0, beam * F.sin(F.radians(s.elevation)))


def day_length(s: Sun, lat: Column) -> Column:
    """Hours with the sun's centre over the geometric horizon, 0 or 24 beyond the polar circles."""
    x = -F.tan(F.radians(lat)) * F.tan(F.radians(s.declination))
    return F.when(x <= -1, 24.0).when(x >= 1, 0.0).otherwise(F.degrees(F.acos(x)) * 2 / 15)


def clearness(cloudiness: Column) -> Column:
    """Share of the clear sky's radiation under clouds; null outside 0 to 1."""
    return F.when(cloudiness.between(0, 1), 1 - CLOUD_FACTOR * F.pow(cloudiness, CLOUD_POWER))


def cloudiness(index: Column) -> Column:
    """Cloudiness from the ratio of measured to clear-sky radiation."""
    return F.when(index > 1, 0.0).when(index.isNotNull(), F.least(F.lit(1.0), F.pow((1 - index) / CLOUD_FACTOR, 1 / CLOUD_POWER)))
