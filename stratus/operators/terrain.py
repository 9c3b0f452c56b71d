"""Terrain of elevation grids given as rows (grid, i, j, value); j grows to the north.

Neighbours come from two windows, along the rows and then along the columns, by index and not by place, so gaps are null.
A cell is given for every place of the grid, with a null value where nothing is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(cells: DataFrame, step: int = 1) -> DataFrame:
    """``cells`` with columns sw s se w e nw n ne: values ``step`` cells away."""
    row = Window.partitionBy("grid", "j").orderBy("i")
    col = Window.partitionBy("grid", "i").orderBy("j")
    here = lambda c, w, d: F.max(c).over(w.rangeBetween(d, d))
    sides = cells.withColumns({"w": here("value", row, -step), "e": here("value", row, step)})
    out = {}
    for name, d in (("s", -step), ("n", step)):
        out |= {name + "w": here("w", col, d), name: here("value", col, d), name + "e": here("e", col, d)}
    return sides.withColumns(out)


def _normal(scheme: str, size: float) -> tuple[Column, Column]:
    c = F.col
    east = {
        "HORN": lambda: (c("nw") + 2 * c("w") + c("sw") - c("ne") - 2 * c("e") - c("se")) / (8 * size),
        "FLEMING": lambda: (c("w") - c("e")) / (2 * size),
        "CORRIPIO": lambda: (c("sw") + c("nw") - c("se") - c("ne")) / (4 * size),
    }[scheme]()
    north = {
        "HORN": lambda: (c("sw") + 2 * c("s") + c("se") - c("nw") - 2 * c("n") - c("ne")) / (8 * size),
        "FLEMING": lambda: (c("s") - c("n")) / (2 * size),
        "CORRIPIO": lambda: (c("sw") - c("nw") + c("se") - c("ne")) / (4 * size),
    }[scheme]()
    return east, north


def slope_aspect(cells: DataFrame, size: float, scheme: str = "HORN") -> DataFrame:
    """Adds nx, ny, slope and azimuth in degrees; null where a neighbour that the scheme needs is missing, azimuth 0 where flat."""
    east, north = _normal(scheme, size)
    out = neighbours(cells).withColumns({"nx": F.when(F.col("value").isNotNull(), east), "ny": F.when(F.col("value").isNotNull(), north)})
    slope = F.degrees(F.atan(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny"))))
    bearing = F.pmod(450 - F.round(F.degrees(F.atan2("ny", "nx")), 1), F.lit(360.0))
    straight = F.when(F.col("ny") < 0, 180.0).otherwise(0.0)
    azimuth = F.when(F.col("slope") == 0, 0.0).when(F.col("nx") == 0, straight).otherwise(bearing)
    return out.withColumn("slope", slope).withColumn("azimuth", azimuth).drop("nw", "n", "ne", "w", "e", "sw", "s", "se")


def curvature(cells: DataFrame, size: float, step: int = 1) -> DataFrame:
    """Adds the mean over four axes of the height above the axis ends, per distance; the cell stands in for one missing end."""
    near = neighbours(cells, step)
    z, total, count = F.col("value"), F.lit(0.0), F.lit(0)
    for a, b, far in (("w", "e", 1.0), ("s", "n", 1.0), ("sw", "ne", 2**0.5), ("nw", "se", 2**0.5)):
        some = F.col(a).isNotNull() | F.col(b).isNotNull()
        rise = F.when(some, (z - (F.coalesce(a, z) + F.coalesce(b, z)) / 2) / (2 * step * size * far))
        total, count = total + F.coalesce(rise, F.lit(0.0)), count + some.cast("int")
    return near.withColumn("curvature", F.when(z.isNotNull(), total / F.nullif(count, F.lit(0)))).drop("nw", "n", "ne", "w", "e", "sw", "s", "se")


def hillshade(slope: Column, azimuth: Column, elevation: float, sun_azimuth: float) -> Column:
    """Light of 0 to 1 on a slope under a sun at ``elevation`` and ``sun_azimuth`` degrees."""
    zenith = F.radians(F.lit(90.0 - elevation))
    light = F.cos(zenith) * F.cos(F.radians(slope)) + F.sin(zenith) * F.sin(F.radians(slope)) * F.cos(F.radians(sun_azimuth - azimuth))
    return F.when(light < 0, 0.0).otherwise(light)
