"""Physics of the lower atmosphere as column expressions; SI units, null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Physical constants in SI units.
STEFAN_BOLTZMANN = 5.670373e-8
GRAVITY = 9.80665
STD_PRESSURE, STD_TEMPERATURE = 101325.0, 288.15
LAPSE_RATE = 0.0065
GAS_DRY_AIR, GAS_WATER, GAS = 287.058, 461.9, 8.31451
MOL_MASS_AIR, MOL_MASS_WATER = 0.0289644, 18.0153e-3
EARTH_RADIUS = 6356766.0
P_TRIPLE, T_TRIPLE, T_FREEZE = 611.73, 273.16, 273.15


def black_body(emissivity: Column, t: Column) -> Column:
    return emissivity * STEFAN_BOLTZMANN * F.pow(t, 4)


def black_body_emissivity(lwr: Column, t: Column) -> Column:
    return F.least(lwr / (STEFAN_BOLTZMANN * F.pow(t, 4)), F.lit(1.0))


def std_pressure(altitude: Column) -> Column:
    drop = LAPSE_RATE * EARTH_RADIUS * altitude / (STD_TEMPERATURE * (EARTH_RADIUS + altitude))
    return STD_PRESSURE * F.pow(1 - drop, F.lit(GRAVITY / (LAPSE_RATE * GAS_DRY_AIR)))


def gravity(altitude: Column, latitude: Column) -> Column:
    s, s2 = F.sin(F.radians(latitude)), F.sin(2 * F.radians(latitude))
    return 9.780356 * (1 + 0.0052885 * s * s - 0.0000059 * s2 * s2) - 0.003086 * altitude * 1e-3


def sea_level_pressure(pressure: Column, altitude: Column, latitude: Column) -> Column:
    return pressure / F.pow(1 - LAPSE_RATE * altitude / STD_TEMPERATURE, MOL_MASS_AIR * gravity(altitude, latitude) / (GAS * LAPSE_RATE))


def saturation_pressure(t: Column) -> Column:
    """Over ice below the triple point, over water above."""
    ice, water = 21.88 * (t - T_TRIPLE) / (t - 7.66), 17.27 * (t - T_TRIPLE) / (t - 35.86)
    return P_TRIPLE * F.exp(F.when(t < T_TRIPLE, ice).otherwise(water))


def saturation_pressure_water(t: Column) -> Column:
    return P_TRIPLE * F.exp(17.27 * (t - T_TRIPLE) / (t - 35.86))


def vapour_density(t: Column, e: Column) -> Column:
    return MOL_MASS_WATER * e / (GAS * t)


def virtual_temperature_factor(e: Column, p: Column) -> Column:
    return 1 / (1 - 0.378 * e / p)


def dew_point(rh: Column, t: Column) -> Column:
    """Water above freezing, ice below -16 °C, a blend weighted by squared distances in between."""
    c, rh = t - T_FREEZE, rh + 0.0001

    def phase(a: float, b: float, k: float) -> Column:
        log = F.log(rh * a * F.exp(b * c / (k + c)) / a)
        return k * log / (b - log)

    water, ice = phase(611.21, 17.502, 240.97), phase(611.15, 22.452, 272.55)
    near_ice, near_water = 1 / (F.pow(c + 16, 2) + 1e-6), 1 / (c * c + 1e-6)
    blend = (near_ice * ice + near_water * water) / (near_ice + near_water)
    return T_FREEZE + F.when(c >= 0, water).when(c < -16, ice).otherwise(blend)


def relative_humidity(td: Column, t: Column) -> Column:
    """From a dew point: over water above freezing, over ice below -16 °C, a blend weighted by squared distances in between."""
    c, d = t - T_FREEZE, td - T_FREEZE

    def phase(b: float, k: float) -> Column:
        return F.exp(b * d / (k + d)) / F.exp(b * c / (k + c))

    water, ice = phase(17.502, 240.97), phase(22.452, 272.55)
    near_ice, near_water = 1 / (F.pow(c + 16, 2) + 1e-6), 1 / (c * c + 1e-6)
    blend = (near_ice * ice + near_water * water) / (near_ice + near_water)
    return F.when(td.isNotNull(), F.least(F.lit(1.0), F.when(c >= 0, water).when(c < -16, ice).otherwise(blend)))


def absolute_humidity(rh: Column, t: Column) -> Column:
    """Vapour density in kg/m³."""
    return rh * saturation_pressure(t) / (t * GAS_WATER)


def specific_humidity(altitude: Column, t: Column, rh: Column) -> Column:
    """Mass of vapour over mass of air, at the standard pressure of an altitude."""
    dry = std_pressure(altitude) / (GAS_DRY_AIR * t)
    return 1 / (dry / (rh * vapour_density(t, saturation_pressure(t))) + 1)


def relative_from_specific(altitude: Column, t: Column, q: Column) -> Column:
    dry = std_pressure(altitude) / (GAS_DRY_AIR * t)
    return F.when(q.isNotNull(), F.least(F.lit(1.0), q / (1 - q) * dry / vapour_density(t, saturation_pressure(t))))


def wind_log_profile(v: Column, z_ref: float, z: float, z0: float = 0.03) -> Column:
    import math

    return v * (math.log(z / z0) / math.log(z_ref / z0))


def wind_chill(t: Column, v: Column) -> Column:
    c, p = t - T_FREEZE, F.pow(v * 3.6, 0.16)
    return F.when((t > T_FREEZE + 10) | (v < 5), t).otherwise(13.12 + 0.6215 * c - 11.37 * p + 0.3965 * c * p + T_FREEZE)


#: Coefficients of the heat index in t, rh, t·rh, t², rh², t²·rh, t·rh², t²·rh² after the constant.
HEAT_INDEX = (-8.784695, 1.61139411, 2.338549, -0.14611605, -1.2308094e-2, -1.6424828e-2, 2.211732e-3, 7.2546e-4, -3.582e-6)


def heat_index(t: Column, rh: Column) -> Column:
    c, r = t - T_FREEZE, rh * 100
    terms = (F.lit(1.0), c, r, c * r, c * c, r * r, c * c * r, c * r * r, c * c * r * r)
    return F.when((t < T_FREEZE + 26.7) | (rh < 0.4), t).otherwise(sum(k * x for k, x in zip(HEAT_INDEX, terms, strict=True)) + T_FREEZE)


def clear_sky_longwave(scheme: str, rh: Column, t: Column) -> Column:
    """Incoming longwave radiation of a clear sky by BRUTSAERT, DILLEY, PRATA, CLARK, TANG or IDSO."""
    e = rh * saturation_pressure(t)
    water = 4650 * e * 0.001 / t
    if scheme == "DILLEY":
        return 59.38 + 113.7 * F.pow(t / T_TRIPLE, 6) + 96.96 * F.sqrt(water / 25)
    emissivity = {
        "BRUTSAERT": lambda: F.least(1.24 * F.pow(0.01 * e / t, 1 / 7), F.lit(1.0)),
        "PRATA": lambda: F.least(1 - (1 + water) * F.exp(-F.sqrt(1.2 + 3 * water)), F.lit(1.0)),
        "CLARK": lambda: 0.787 + 0.0028 * (dew_point(rh, t) - T_TRIPLE),
        "TANG": lambda: F.least(0.754 + 0.0044 * (dew_point(rh, t) - T_TRIPLE), F.lit(1.0)),
        "IDSO": lambda: F.least(0.70 + 5.95e-5 * e * 0.01 * F.exp(1500 / t), F.lit(1.0)),
    }[scheme]()
    return black_body(emissivity, t)


def all_sky_longwave(scheme: str, rh: Column, t: Column, cloudiness: Column) -> Column:
    """Incoming longwave radiation under clouds by OMSTEDT, KONZELMANN or CARMONA."""
    e = rh * saturation_pressure(t)
    w = F.pow(cloudiness, 4)
    emissivity = {
        "OMSTEDT": lambda: F.least(0.97 * (0.68 + 0.0036 * F.sqrt(e)) * (1 + 0.18 * cloudiness * cloudiness), F.lit(1.0)),
        "KONZELMANN": lambda: (1 - w) * (0.23 + 0.484 * F.pow(e / t, 1 / 8)) + w * 0.952,
        "CARMONA": lambda: -0.34 + 3.36e-3 * t + 1.94e-3 * rh * 100 + 0.213 * cloudiness,
    }[scheme]()
    return black_body(emissivity, t)


def wind_components(vw: Column, dw: Column) -> tuple[Column, Column]:
    return -vw * F.sin(F.radians(dw)), -vw * F.cos(F.radians(dw))


def wind_direction(u: Column, v: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(u, v)) + 180, F.lit(360.0))
