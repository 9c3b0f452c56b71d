"""Station values onto grid cells. Full inverse distances meet all pairs of a region in blocks; neighbours are looked up over tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.functions import atmosphere as air
from stratus.operators.neighbours import closest

#: Stations and cells that meet in a task at once, on average; larger regions are dealt to parts of stations and shares of cells.
STATIONS, CELLS = 65_536, 32_768
#: Cells and stations of a block that stays in a core's cache.
_ROWS, _COLUMNS = 32, 4096


def _places(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row of each place, place of each row)."""
    order = np.lexsort((y, x))
    new = np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])[: len(x)]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def weighted(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, v: np.ndarray, scale: float, alpha: float) -> np.ndarray:
    """For each cell at ``x``, ``y`` the sums of w * v over all stations, w = 1 / sqrt(d² + scale²) ** alpha; ``v`` has a row for each station."""
    out = np.zeros((len(x), v.shape[1]))
    one, two = np.empty((_ROWS, _COLUMNS)), np.empty((_ROWS, _COLUMNS))
    for i in range(0, len(x), _ROWS):
        cx, cy = x[i : i + _ROWS, None], y[i : i + _ROWS, None]
        for j in range(0, len(sx), _COLUMNS):
            near = slice(j, j + _COLUMNS)
            a, b = (c[: len(cx), : len(sx[near])] for c in (one, two))
            for c, s, to in ((cx, sx, a), (cy, sy, b)):
                np.subtract(c, s[near], out=to)
                np.multiply(to, to, out=to)
            np.add(a, b, out=a)
            np.add(a, scale * scale, out=a)
            np.sqrt(a, out=a)
            np.divide(1.0, a, out=a)
            if alpha != 1:
                np.power(a, alpha, out=a)
            out[i : i + _ROWS] += a @ v[near]
    return out


def fields(cells: DataFrame, stations: DataFrame, values: list[str], scale: float = 1000.0, alpha: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(region, cell, keep, values): means of the stations' ``values`` by inverse distance weights 1 / sqrt(d² + scale²) ** alpha.

    All cells meet all stations of their region that have all ``values``, exactly, in tasks of bounded size. Stations in one place go as
    their sum, cells in one place are calculated once. Stations without coordinates play no part, cells without them are null.
    """
    placed = lambda df: df.withColumns({c: F.col(c).cast("double") for c in "xy"})
    seen = placed(stations.where(" AND ".join(f"`{c}` IS NOT NULL" for c in values)).select("region", "x", "y", *(F.col(c).cast("double").alias(f"v{k}_") for k, c in enumerate(values))))
    number = lambda df, most, name: df.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    sizes = number(cells, CELLS, "shares").join(number(seen, STATIONS, "parts"), "region")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = placed(cells.select("region", "cell", "x", "y", *keep)).join(sizes, "region")
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("cell"), F.col("shares")).cast("int")).withColumn("part", all_of("parts")).drop("shares", "parts")
    near = seen.join(sizes, "region")
    near = near.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int")).withColumn("share", all_of("shares")).drop("shares", "parts")
    own, sums = ["region", "cell", *keep], [*(f"v{k}_" for k in range(len(values))), "w_"]
    schema = ", ".join([*(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in own), *(f"{c} double" for c in sums)])

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        x, y, sx, sy, *v = (t[c].to_numpy() for t, names in ((mine, "xy"), (theirs, ["x", "y", *sums[:-1]])) for c in names)
        lost = np.array(mine["x"].is_null()) | np.array(mine["y"].is_null())
        there = ~(np.array(theirs["x"].is_null()) | np.array(theirs["y"].is_null()))
        sx, sy, v = sx[there], sy[there], np.column_stack([*v, np.ones(len(there))])[there]
        with np.errstate(all="ignore"):
            at, place = _places(sx, sy)
            v = np.column_stack([np.bincount(place, column, len(at)) for column in v.T])
            spots, spot = _places(x, y)
            out = weighted(x[spots], y[spots], sx[at], sy[at], v, scale, alpha)[spot]
        return pa.table([*(mine[c] for c in own), *(pa.array(c, mask=lost) for c in out.T)], names=[*own, *sums])

    keys = ["region", "share", "part"]
    met = dealt.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(meet, schema)
    total = met.groupBy(*own).agg(*(F.sum(c).alias(c) for c in sums))
    return total.select(*own, *((F.col(f"v{k}_") / F.nullif(F.col("w_"), F.lit(0.0))).alias(c) for k, c in enumerate(values)))


def idw(cells: DataFrame, stations: DataFrame, scale: float = 1000.0, alpha: float = 1.0) -> DataFrame:
    """Inverse distance weights 1 / sqrt(d² + scale²) ** alpha."""
    return fields(cells, stations, ["value"], scale, alpha)


def nearest(cells: DataFrame, stations: DataFrame) -> DataFrame:
    """Value of the closest station, of the largest id among equals."""
    return closest(cells, stations, 1, last=True).select("region", "cell", "value")


def average(cells: DataFrame, stations: DataFrame) -> DataFrame:
    return cells.join(stations.groupBy("region").agg(F.avg("value").alias("value")), "region").select("region", "cell", "value")


def lapse(stations: DataFrame) -> DataFrame:
    """(region, slope, icept): values against altitude; a region at one altitude has slope 0."""
    fit = stations.groupBy("region").agg(F.regr_slope("value", "alt").alias("slope"), F.avg("value").alias("v"), F.avg("alt").alias("a"))
    slope = F.coalesce("slope", F.lit(0.0))
    return fit.select("region", slope.alias("slope"), (F.col("v") - slope * F.col("a")).alias("icept"))


def idw_lapse(cells: DataFrame, stations: DataFrame, scale: float = 1000.0, alpha: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(region, cell, keep, value): IDW of the residuals from the altitude trend, plus the trend at the cell."""
    trend = lapse(stations)
    flat = stations.join(trend, "region").withColumn("value", F.col("value") - F.col("slope") * F.col("alt") - F.col("icept")).drop("slope", "icept")
    rest = fields(cells, flat, ["value"], scale, alpha, ("alt", *keep))
    return rest.join(trend, "region").select("region", "cell", *keep, (F.col("value") + F.col("slope") * F.col("alt") + F.col("icept")).alias("value"))


def average_lapse(cells: DataFrame, stations: DataFrame) -> DataFrame:
    """The altitude trend of a region's stations at each cell; the mean of its residuals is zero."""
    return cells.join(lapse(stations), "region").select("region", "cell", (F.col("slope") * F.col("alt") + F.col("icept")).alias("value"))


def local_idw_lapse(cells: DataFrame, stations: DataFrame, neighbours: int, most: float | None = None, scale: float = 1000.0, alpha: float = 1.0) -> DataFrame:
    """IDW_LAPSE with the trend of each cell's closest stations, at most ``neighbours`` of them within ``most`` metres."""
    near = closest(cells, stations.where(F.col("alt").isNotNull()), neighbours, most).withColumn("w", F.pow(1 / F.sqrt(F.col("d2") + scale * scale), alpha))
    fit = near.groupBy("region", "cell").agg(
        F.first("alt").alias("alt"), F.coalesce(F.regr_slope("value", "salt"), F.lit(0.0)).alias("slope"), F.sum("w").alias("w"),
        F.sum(F.col("w") * F.col("value")).alias("wv"), F.sum(F.col("w") * F.col("salt")).alias("wa"), F.count(F.lit(1)).alias("n"),
    )
    # the intercepts of detrending and retrending cancel
    value = F.col("wv") / F.col("w") + F.when(F.col("n") > 1, F.col("slope") * (F.col("alt") - F.col("wa") / F.col("w"))).otherwise(0.0)
    return fit.select("region", "cell", value.alias("value"))


def std_pressure(cells: DataFrame, stations: DataFrame, scale: float | None = None) -> DataFrame:
    """The standard atmosphere at each cell plus the stations' residuals from it: their mean, or their IDW where ``scale`` is given."""
    off = stations.withColumn("value", F.col("value") - air.std_pressure(F.col("alt")))
    if scale is None:
        rest = cells.join(off.groupBy("region").agg(F.avg("value").alias("value")), "region")
    else:
        rest = fields(cells, off, ["value"], scale, keep=("alt",))
    return rest.select("region", "cell", (F.col("value") + air.std_pressure(F.col("alt"))).alias("value"))


def idw_wind(cells: DataFrame, stations: DataFrame, scale: float = 1000.0, alpha: float = 1.0) -> DataFrame:
    """(region, cell, vw, dw): IDW of both components of the stations' wind ``vw`` and ``dw``."""
    u, v = air.wind_components(F.col("vw"), F.col("dw"))
    mean = fields(cells, stations.withColumns({"u": u, "v": v}), ["u", "v"], scale, alpha)
    return mean.select("region", "cell", F.hypot("u", "v").alias("vw"), air.wind_direction(F.col("u"), F.col("v")).alias("dw"))


def longwave_by_emissivity(cells: DataFrame, stations: DataFrame, scale: float = 1000.0, alpha: float = 1.0) -> DataFrame:
    """ILWR_EPS: IDW_LAPSE of the stations' emissivity (``value`` over the black body at ``ta``), times the black body at the cell's ``ta``."""
    eps = idw_lapse(cells, stations.withColumn("value", air.black_body_emissivity(F.col("value"), F.col("ta"))), scale, alpha, ("ta",))
    return eps.select("region", "cell", air.black_body(F.col("value"), F.col("ta")).alias("value"))


def humidity_by_dew_point(cells: DataFrame, stations: DataFrame, scale: float = 1000.0, alpha: float = 1.0) -> DataFrame:
    """LISTON_RH: IDW_LAPSE of the dew points of stations with ``rh`` (0 to 1) and ``ta``, as relative humidity at the cell's ``ta``.

    Stations without one of both or with a humidity outside 0 to 1 play no part; cells without ``ta`` are null.
    """
    known = stations.where(F.col("rh").between(0, 1) & F.col("ta").isNotNull())
    dew = idw_lapse(cells, known.withColumn("value", air.dew_point(F.col("rh"), F.col("ta"))), scale, alpha, ("ta",))
    return dew.select("region", "cell", F.when(F.col("ta").isNotNull(), air.relative_humidity(F.col("value"), F.col("ta"))).alias("value"))


def rain_share(ta: Column, snow: float, rain: float | None = None) -> Column:
    """PPHASE: share of rain in the precipitation at air temperature ``ta``.

    Without ``rain`` it is 0 below the threshold ``snow`` and 1 from there on, else it grows from the lower to the higher one of both.
    """
    if rain is None:
        return F.when(ta >= snow, 1.0).when(ta.isNotNull(), 0.0)
    low, high = sorted((snow, rain))
    if low == high:
        raise ValueError("the thresholds of snow and rain must differ")
    grown = (ta - low) / (high - low)
    return F.when(grown > 1, 1.0).when(grown < 0, 0.0).otherwise(grown)


def precipitation_phase(temperature: DataFrame, snow: float, rain: float | None = None) -> DataFrame:
    """``rain_share`` of each cell, from a field (region, cell, value) of air temperature."""
    return temperature.select("region", "cell", rain_share(F.col("value"), snow, rain).alias("value"))


#: How well an algorithm suits 0, 1, 2 and more stations.
RATINGS = {
    "NONE": (1e-12, 1e-12, 1e-12, 1e-12),
    "CST": (0.01, 0.01, 0.01, 0.01),
    "AVG": (0.0, 0.8, 0.2, 0.2),
    "AVG_LAPSE": (0.0, 0.0, 0.7, 0.2),
    "IDW": (0.0, 0.3, 0.5, 0.5),
    "IDW_LAPSE": (0.0, 0.0, 0.7, 0.7),
    "NEAREST": (0.0, 0.99, 0.99, 0.99),
}


def constant(cells: DataFrame, value: float | None) -> DataFrame:
    return cells.select("region", "cell", F.lit(value).cast("double").alias("value"))


def interpolate(cells: DataFrame, stations: DataFrame, algorithms: list[str], fallback: float = 0.0, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(region, cell, value, algorithm): each region by that of ``algorithms`` that suits its number of stations best, the first of equals.

    ``fallback`` is the value of CST; values are clamped to ``bounds``. Cells of regions that no algorithm suits are null.
    """
    run = {
        "NONE": lambda c: constant(c, None), "CST": lambda c: constant(c, fallback), "AVG": lambda c: average(c, stations), "AVG_LAPSE": lambda c: average_lapse(c, stations),
        "IDW": lambda c: idw(c, stations), "IDW_LAPSE": lambda c: idw_lapse(c, stations), "NEAREST": lambda c: nearest(c, stations),
    }
    best = [max([*algorithms, "NONE"], key=lambda a: RATINGS[a][k]) for k in range(4)]
    stations = stations.where(F.col("value").isNotNull())
    number = stations.groupBy("region").agg(F.least(F.count(F.lit(1)), F.lit(3)).alias("n"))
    sized = cells.join(number, "region", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = None
    for name in dict.fromkeys(best):
        mine = sized.where(F.col("n").isin([k for k in range(4) if best[k] == name])).drop("n")
        found = run[name](mine).withColumn("algorithm", F.lit(name))
        out = found if out is None else out.unionByName(found)
    if bounds:
        out = out.withColumn("value", F.when(F.col("value").isNotNull(), F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), F.col("value")))))
    return out
