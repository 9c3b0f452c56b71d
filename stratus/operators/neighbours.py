"""The stations closest to each cell, over tiles that double until a block of nine provably holds them.

A tile of level 0 has about as many stations as are asked for. A cell meets the stations of the nine tiles around it; it is done
if the last one it needs is closer than anything outside the block can be, else it goes on to tiles of twice the side.
Tiles end with the box of a region's stations, and a cell outside of it looks from the nearest point of the box, so there are at most
about log2 of the number of stations levels, and few cells go beyond the second. Of stations in one place, as many as are asked
for are enough. A region's cells and stations spread over all its tiles: none is in one task. Where stations are crowded in a corner,
cells that have only that crowd in reach meet all of its places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratus.operators.saved import saved


def _boxes(stations: DataFrame, k: int) -> DataFrame:
    """(region, x0, y0, width, height, side) of the stations; ``side`` of a tile that holds k on average."""
    w, h, n = F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count(F.lit(1))
    side = F.greatest(F.sqrt(w * h * k / n), F.greatest(w, h) * k / n)
    return stations.groupBy("region").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), w.alias("width"), h.alias("height"), F.when(side > 0, side).otherwise(1.0).alias("side"))


def _tile(at: str, origin: str) -> Column:
    return F.floor((F.col(at) - F.col(origin)) / F.col("side")).cast("long")


def _reach2(level: int) -> Column:
    """Square of the distance that any station outside a cell's block has at least: off the box, and from there to the block's inner borders."""
    size, sides = F.col("side") * 2**level, []
    for p, tile, length in (("px", "tx", "width"), ("py", "ty", "height")):
        low, high = (F.shiftright(tile, level) - 1) * size, (F.shiftright(tile, level) + 2) * size
        sides += [F.when(low > 0, F.col(p) - low), F.when(high <= F.col(length), high - F.col(p))]
    inner = F.least(*sides) - 1e-9 * size  # nulls do not count: there is no station beyond the box
    return F.when(inner.isNull(), float("inf")).otherwise(F.col("off2") + F.pow(F.greatest(inner, F.lit(0.0)), 2))


def closest(cells: DataFrame, stations: DataFrame, k: int, most: float | None = None, last: bool = False) -> DataFrame:
    """Cells (region, cell, x, y, alt) with their k closest stations within ``most``: sx, sy, salt, value, station, squared distance d2 and place from 1.

    Equal distances are in the order of station ids, the largest first with ``last``. Stations without value or coordinates play no
    part; cells without coordinates and cells with no station in reach have no row. A cell's id is unique in its region.
    """
    by_id = F.col("station").desc() if last else F.col("station")
    seen = stations.where("value IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    heap = F.row_number().over(Window.partitionBy("region", "x", "y").orderBy(by_id))
    seen = seen.withColumn("heap", heap).where(F.col("heap") <= k).select("region", "x", "y", "alt", "value", "station")
    boxes = saved(_boxes(seen, k), "boxes")
    near = seen.join(boxes.select("region", "x0", "y0", "side"), "region").withColumns({"tx": _tile("x", "x0"), "ty": _tile("y", "y0")})
    near = saved(near.select("region", "tx", "ty", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("alt").alias("salt"), "value", "station"), "near")
    inside = lambda p, o, length: F.greatest(F.lit(0.0), F.least(F.col(p) - F.col(o), F.col(length)))
    todo = cells.select("region", "cell", "x", "y", "alt").where("x IS NOT NULL AND y IS NOT NULL").join(boxes, "region")
    todo = todo.withColumns({"px": inside("x", "x0", "width"), "py": inside("y", "y0", "height")})
    todo = todo.withColumns({"tx": F.floor(F.col("px") / F.col("side")).cast("long"), "ty": F.floor(F.col("py") / F.col("side")).cast("long")})
    off2 = F.pow(F.col("x") - F.col("x0") - F.col("px"), 2) + F.pow(F.col("y") - F.col("y0") - F.col("py"), 2)
    todo = todo.withColumn("off2", off2).drop("x0", "y0")
    kept, found, level, out = todo.columns, ["sx", "sy", "salt", "value", "station", "d2", "place"], 0, None
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    rank = F.row_number().over(Window.partitionBy("region", "cell").orderBy(F.col("d2").asc_nulls_last(), by_id))
    while True:
        blocks = near.withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
        blocks = blocks.withColumns({"bx": F.shiftright("tx", level) + F.col("i"), "by": F.shiftright("ty", level) + F.col("j")}).drop("tx", "ty", "i", "j")
        mine = todo.withColumns({"bx": F.shiftright("tx", level), "by": F.shiftright("ty", level)})
        both = mine.join(blocks, ["region", "bx", "by"], "left").withColumn("d2", F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2))
        best = both.withColumn("place", rank).where(F.col("place") <= k)
        reach2, whole = _reach2(level), Window.partitionBy("region", "cell")
        full = (F.count("station").over(whole) == k) & (F.max("d2").over(whole) < reach2)
        done = full | (reach2 == float("inf")) | (F.lit(False) if most is None else reach2 > most * most)
        turn = saved(best.withColumn("done", done).select(*kept, *found, "done"), f"closest-{level}")
        part = turn.where("done AND station IS NOT NULL").select("region", "cell", "x", "y", "alt", *found)
        out = part if out is None else out.unionByName(part)
        todo = turn.where("NOT done AND place = 1").select(*kept)
        if todo.isEmpty():
            return out if most is None else out.where(F.col("d2") <= most * most)
        level += 1
