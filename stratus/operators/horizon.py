"""Horizons and sky view of elevation grids given as rows (grid, i, j, value); j grows to the north.

Rays march over tiles that carry a margin as wide as rays reach, so a cell meets the cells of its rays in one array and no cell is
joined to others. A tile holds TILE cells on each side and its margin, whatever the size of the grid. Missing cells have null
results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a tile on each side.
TILE = 256
#: Height of the sun in degrees that bounds how far rays reach, sectors of the sky.
LOW_SUN, SECTORS = 5.0, 32


def _away(x: float) -> int:
    """Rounded, halves away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def _ray(bearing: float, reach: float, first: int) -> list[tuple[int, int, float]]:
    """(columns, rows, cells of distance) of a ray's steps up to the first one beyond ``reach`` cells."""
    sin, cos, out, k = math.sin(math.radians(bearing)), math.cos(math.radians(bearing)), [], first
    while not out or out[-1][2] <= reach:
        x, y = _away(k * sin), _away(k * cos)
        out.append((x, y, math.hypot(x, y)))
        k += 1
    return out


class _Tile:
    """The cells of a tile in the middle of an array of known heights."""

    def __init__(self, pdf: pd.DataFrame, tile: int):
        row = pdf.iloc[0]
        self.reach, self.margin = float(row["reach_"]), int(row["margin_"])
        self.i0, self.j0 = int(row["ti_"]) * tile, int(row["tj_"]) * tile
        wide, m = tile + 2 * self.margin, self.margin
        self.all = np.full((wide, wide), np.nan)
        self.all[pdf["j"].to_numpy() - self.j0 + m, pdf["i"].to_numpy() - self.i0 + m] = pdf["value"].to_numpy(float)
        own = pdf["own_"].to_numpy(bool)
        self.i, self.j = pdf["i"].to_numpy()[own], pdf["j"].to_numpy()[own]
        self.z = self.all[self.j - self.j0 + m, self.i - self.i0 + m]
        self.ends = tuple(int(row[c]) for c in ("i_lo_", "i_hi_", "j_lo_", "j_hi_"))

    def at(self, x: int, y: int) -> np.ndarray:
        return self.all[self.j + (y - self.j0 + self.margin), self.i + (x - self.i0 + self.margin)]

    def within(self, x: int, y: int, border: int) -> np.ndarray:
        a, b, c, d = self.ends
        i, j = self.i + x, self.j + y
        return (i >= a + border) & (i <= b - border) & (j >= c + border) & (j <= d - border)


def _tiled(cells: DataFrame, size: float, reach: float | None, tile: int, carried: list[str]) -> DataFrame:
    """``cells`` dealt to the tiles that need them, with the grid's ends and the cells that rays reach."""
    ends = cells.groupBy("grid").agg(F.min("i").alias("i_lo_"), F.max("i").alias("i_hi_"), F.min("j").alias("j_lo_"), F.max("j").alias("j_hi_"), (F.max("value") - F.min("value")).alias("relief_"))
    own = F.greatest(F.col("relief_") / math.tan(math.radians(LOW_SUN)) / size, F.lit(1.5)) if reach is None else F.lit(reach / size)
    # a ray goes one step beyond its reach, and no farther than the grid
    ends = ends.withColumn("reach_", F.coalesce(own, F.lit(1.5))).withColumn("margin_", F.least(F.floor("reach_") + 2, F.greatest(F.col("i_hi_") - F.col("i_lo_"), F.col("j_hi_") - F.col("j_lo_")) + 2).cast("long"))
    tiles = lambda c, lo, hi: F.sequence(F.floor(F.greatest(F.col(c) - F.col("margin_"), F.col(lo)) / tile).cast("long"), F.floor(F.least(F.col(c) + F.col("margin_"), F.col(hi)) / tile).cast("long"))
    rows = cells.select("grid", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("value"), *carried).join(ends.drop("relief_"), "grid")
    rows = rows.withColumn("ti_", F.explode(tiles("i", "i_lo_", "i_hi_"))).withColumn("tj_", F.explode(tiles("j", "j_lo_", "j_hi_")))
    return rows.withColumn("own_", (F.col("ti_") == F.floor(F.col("i") / tile)) & (F.col("tj_") == F.floor(F.col("j") / tile)))


def horizon(cells: DataFrame, size: float, bearings: list[float], reach: float | None = None, tile: int = TILE) -> DataFrame:
    """(grid, i, j, bearing, horizon): tangent of the horizon's angle toward each bearing, 0 at least.

    A ray begins two cells away and ends at a missing cell, at the grid's border or beyond ``reach`` metres (without one, where
    the grid's relief is lower than a sun of LOW_SUN degrees). Cells of the border have no horizon, 0.
    """

    def march(pdf: pd.DataFrame) -> pd.DataFrame:
        t, out = _Tile(pdf, tile), []
        for bearing in bearings:
            best, on = np.zeros(len(t.z)), t.within(0, 0, 1)
            for x, y, far in _ray(bearing, t.reach, 2):
                on = on & t.within(x, y, 1)
                if not on.any():
                    break
                height = np.where(on, t.at(np.where(on, x, 0), np.where(on, y, 0)), np.nan)
                on = on & ~np.isnan(height)
                best = np.where(on, np.fmax(best, (height - t.z) / (far * size)), best)
            out.append(pd.DataFrame({"grid": pdf["grid"].iloc[0], "i": t.i, "j": t.j, "bearing": float(bearing), "horizon": np.where(np.isnan(t.z), np.nan, best)}))
        return pd.concat(out)

    kind = cells.schema["grid"].dataType.simpleString()
    out = _tiled(cells, size, reach, tile, []).groupBy("grid", "ti_", "tj_").applyInPandas(march, f"grid {kind}, i long, j long, bearing double, horizon double")
    return out.withColumn("horizon", F.nanvl("horizon", F.lit(None).cast("double")))


def sky_view(cells: DataFrame, size: float, reach: float | None = None, tile: int = TILE) -> DataFrame:
    """(grid, i, j, sky): share of the sky that a cell with columns slope and azimuth sees, from SECTORS rays over all its neighbours.

    Rays pass over missing cells and end at the grid's border or at ``reach``.
    """

    def march(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _Tile(pdf, tile)
        own = pdf["own_"].to_numpy(bool)
        slope, azimuth, total = np.radians(pdf["slope"].to_numpy(float)[own]), pdf["azimuth"].to_numpy(float)[own], np.zeros(len(t.z))
        for sector in range(SECTORS):
            bearing = 360.0 * sector / SECTORS
            best = np.full(len(t.z), -99_999.0)
            for x, y, far in _ray(bearing, t.reach, 1):
                on = t.within(x, y, 0)
                if far > t.reach or not on.any():
                    break
                height = np.where(on, t.at(np.where(on, x, 0), np.where(on, y, 0)), np.nan)
                best = np.fmax(best, (height - t.z) / (far * size))
            up = np.maximum(np.arctan(best) + np.arctan(np.tan(slope) * np.cos(np.radians(bearing - azimuth))), 0.0)
            total += np.cos(up) ** 2
        return pd.DataFrame({"grid": pdf["grid"].iloc[0], "i": t.i, "j": t.j, "sky": np.where(np.isnan(t.z), np.nan, total / SECTORS)})

    kind = cells.schema["grid"].dataType.simpleString()
    out = _tiled(cells, size, reach, tile, ["slope", "azimuth"]).groupBy("grid", "ti_", "tj_").applyInPandas(march, f"grid {kind}, i long, j long, sky double")
    return out.withColumn("sky", F.nanvl("sky", F.lit(None).cast("double")))
