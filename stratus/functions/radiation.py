"""Clear-sky radiation by broadband transmittances (Bird and Hulstrom, in Iqbal 1983), its projections and its diffuse share, as columns.

Angles are degrees, radiation W/m², temperatures K, humidity 0 to 1, pressure Pa, heights m. Null in gives null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratus.functions.atmosphere import STD_PRESSURE, saturation_pressure
from stratus.functions.sun import SOLAR_CONSTANT

__all__ = ["SOLAR_CONSTANT", "clear_sky", "diffuse_share", "on_horizontal", "on_slope"]

#: Ozone layer in cm; scattered share of the aerosols' attenuation and its forward part; wavelength exponent and amount of particles.
OZONE, SCATTERED, FORWARD, WAVELENGTH, PARTICLES = 0.32, 0.9, 0.84, 1.3, 0.03
#: Height of the sun in degrees below which all radiation is diffuse; diffuse share of a clear sky.
LOW_SUN, CLEAR_SHARE = 5.0, 0.147
#: Aerosol depth of the whole spectrum, from those at 0.38 and 0.5 micrometres.
AEROSOLS = PARTICLES * (0.2758 * 0.38**-WAVELENGTH + 0.35 * 0.5**-WAVELENGTH)


def _air_mass(cos_zenith: Column) -> Column:
    """Relative optical air mass (Young 1994) of the true height."""
    above = 0.0096467 + cos_zenith * (0.148386 + cos_zenith * 1.002432)
    below = 0.000303978 + cos_zenith * (0.0102963 + cos_zenith * (0.149864 + cos_zenith))
    return above / below


def clear_sky(elevation: Column, beam_top: Column, ta: Column, rh: Column, pressure: Column, albedo: Column, altitude: Column) -> Column:
    """(direct, diffuse): the beam at the ground, perpendicular to the sun, and the sky's radiation on the horizontal.

    ``beam_top`` is the beam above the atmosphere, ``albedo`` the ground's. Both are 0 while the sun is below the horizon.
    """
    up = F.sin(F.radians(elevation))
    m = _air_mass(up)
    thick = m * pressure / STD_PRESSURE
    ozone, water = OZONE * m, 0.493 * rh * saturation_pressure(ta) / ta * m
    # what gets through molecules, ozone, mixed gases, water vapour and aerosols
    molecules = F.exp(-0.0903 * F.pow(thick, 0.84) * (1 + thick - F.pow(thick, 1.01)))
    absorbed = 0.1611 * ozone * F.pow(1 + 139.48 * ozone, -0.3035) - 0.002715 * ozone / (1 + ozone * (0.044 + 0.0003 * ozone))
    vapour = 1 - 2.4959 * water / (F.pow(1 + 79.034 * water, 0.6828) + 6.385 * water)
    aerosols = F.exp(-(AEROSOLS**0.873) * (1 + AEROSOLS - AEROSOLS**0.7088) * F.pow(thick, 0.9108))
    scatter = aerosols / (1 - (1 - SCATTERED) * (1 - thick + F.pow(thick, 1.06)) * (1 - aerosols))
    through = (1 - absorbed) * F.exp(-0.0127 * F.pow(thick, 0.26)) * vapour * aerosols
    direct = 0.9751 * beam_top * (molecules * through + 2.2e-5 * F.least(altitude, F.lit(3000.0)))
    once = 0.79 * beam_top * through / (1 - thick + F.pow(thick, 1.02)) * (0.5 * (1 - molecules) + FORWARD * (1 - scatter))
    bounced = albedo * (0.0685 + (1 - FORWARD) * (1 - scatter))
    diffuse = (once + (once + direct) * bounced / (1 - bounced)) * up
    known = ta.isNotNull() & rh.isNotNull() & pressure.isNotNull() & albedo.isNotNull()
    night, low = elevation < 0, elevation < LOW_SUN
    return F.struct(F.when(known, F.when(night | low, 0.0).otherwise(direct)).alias("direct"), F.when(known, F.when(night, 0.0).when(low, diffuse + direct * up).otherwise(diffuse)).alias("diffuse"))


def on_horizontal(beam: Column, elevation: Column) -> Column:
    return beam * F.sin(F.radians(elevation))


def on_slope(beam: Column, elevation: Column, azimuth: Column, slope: Column, bearing: Column) -> Column:
    """A beam on a plane of inclination ``slope`` that faces ``bearing``; 0 from behind."""
    high, tilt = F.radians(elevation), F.radians(slope)
    facing = F.cos(tilt) * F.sin(high) + F.sin(tilt) * F.cos(high) * F.cos(F.radians(azimuth - bearing))
    return F.when(beam.isNotNull() & facing.isNotNull(), F.greatest(F.lit(0.0), beam * facing))


def diffuse_share(measured: Column, top_horizontal: Column, elevation: Column) -> Column:
    """Diffuse part of measured global radiation by the sky's clearness (Reindl et al. 1990); 1 for a low sun."""
    k = measured / F.nullif(top_horizontal, F.lit(0.0))
    cloudy = F.greatest(F.lit(CLEAR_SHARE), F.least(F.lit(0.97), 1.4 - 1.749 * k + 0.177 * F.sin(F.radians(elevation))))
    return F.when(elevation < LOW_SUN, 1.0).when(k >= 0.78, CLEAR_SHARE).when(k <= 0.3, F.least(F.lit(1.0), 1.02 - 0.248 * k)).when(k.isNotNull(), cloudy)
