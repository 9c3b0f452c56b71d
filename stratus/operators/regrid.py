"""Grids at another resolution, from rows (grid, i, j, value) with a row for each place of the grid.

A source cell gathers its stencil by index from one window along the rows and one along the columns, then gives the target cells
whose origin it is: no target is joined to its sources, and nothing is dealt out by more than a line of the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells before and after a source cell that a method reads.
REACH = {"NEAREST": (0, 0), "BILINEAR": (0, 1), "BSPLINE": (-1, 2)}


def _spline(x: Column) -> Column:
    """The cubic B-spline, 0 beyond two cells."""
    cube = lambda d: F.pow(F.greatest(x + d, F.lit(0.0)), F.lit(3.0))
    return (cube(2) - 4 * cube(1) + 6 * cube(0) - 4 * cube(-1)) / 6


def _stencil(cells: DataFrame, low: int, high: int) -> DataFrame:
    """``cells`` with columns v_m_n, the values m columns and n rows away."""
    row, col = Window.partitionBy("grid", "j").orderBy("i"), Window.partitionBy("grid", "i").orderBy("j")
    steps = range(low, high + 1)
    at = lambda c, w, d: F.max(c).over(w.rangeBetween(d, d))
    lines = cells.withColumns({f"r_{m - low}": at("value", row, m) for m in steps})
    return lines.withColumns({f"v_{m - low}_{n - low}": at(f"r_{m - low}", col, n) for m in steps for n in steps}).drop(*(f"r_{m - low}" for m in steps))


def _bilinear(v, border: Column, x: Column, y: Column) -> Column:
    """``v(m, n)`` weighted by nearness; the mean of three stands in for a missing fourth, fewer give null. At the last row and column the cell itself."""
    corners = [(0, 0), (1, 0), (0, 1), (1, 1)]
    known = sum((v(*c).isNotNull().cast("int") for c in corners), F.lit(0))
    mean = sum((F.coalesce(v(*c), F.lit(0.0)) for c in corners), F.lit(0.0)) / known
    share = {(0, 0): (1 - x) * (1 - y), (1, 0): x * (1 - y), (0, 1): (1 - x) * y, (1, 1): x * y}
    total = sum((F.coalesce(v(*c), mean) * share[c] for c in corners), F.lit(0.0))
    return F.when(border, v(0, 0)).when(known >= 3, total)


def resize(cells: DataFrame, factor: float, method: str = "BILINEAR") -> DataFrame:
    """(grid, i, j, value): grids of ``factor`` times the rows and columns (rounded, halves up), indexed from 0, by NEAREST, BILINEAR or BSPLINE.

    BSPLINE stays within its sixteen cells' values; where some of them are missing or beyond the grid, the cell is BILINEAR, where all are, null.
    A grid that would have no row or column left has none.
    """
    if not factor > 0:
        raise ValueError(f"factor {factor} is not above 0")
    low, high = REACH[method]
    plain = cells.select("grid", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("value"))
    ends = plain.groupBy("grid").agg(F.min("i").alias("i0"), F.min("j").alias("j0"), (F.max("i") - F.min("i") + 1).alias("nx"), (F.max("j") - F.min("j") + 1).alias("ny"))
    ends = ends.withColumns({"mx": F.floor(F.col("nx") * factor + 0.5).cast("long"), "my": F.floor(F.col("ny") * factor + 0.5).cast("long")}).where("mx > 0 AND my > 0")
    near = (_stencil(plain, low, high) if high > low else plain.withColumn("v_0_0", F.col("value"))).join(ends, "grid")
    near = near.withColumns({"si": F.col("i") - F.col("i0"), "sj": F.col("j") - F.col("j0"), "ax": F.col("mx") / F.col("nx"), "ay": F.col("my") / F.col("ny")})
    for source, scale, most, out in (("si", "ax", "mx", "ti"), ("sj", "ay", "my", "tj")):
        about = F.sequence(F.greatest(F.floor(F.col(source) * F.col(scale)) - 1, F.lit(0)).cast("long"), F.least(F.ceil((F.col(source) + 1) * F.col(scale)) + 1, F.col(most)).cast("long"))
        near = near.withColumn(out, F.explode(about)).where((F.col(out) < F.col(most)) & (F.floor(F.col(out) / F.col(scale)) == F.col(source)))
    x, y = F.col("ti") / F.col("ax") - F.col("si"), F.col("tj") / F.col("ay") - F.col("sj")
    v = lambda m, n: F.col(f"v_{m - low}_{n - low}")
    if method == "NEAREST":
        value = v(0, 0)
    else:
        value = _bilinear(v, (F.col("si") >= F.col("nx") - 1) | (F.col("sj") >= F.col("ny") - 1), x, y)
    if method == "BSPLINE":
        all_ = [(m, n) for m in range(low, high + 1) for n in range(low, high + 1)]
        known = sum((v(*c).isNotNull().cast("int") for c in all_), F.lit(0))
        total = sum((v(m, n) * _spline(m - x) * _spline(y - n) for m, n in all_), F.lit(0.0))
        held = F.least(F.greatest(total, F.least(*(v(*c) for c in all_))), F.greatest(*(v(*c) for c in all_)))
        value = F.when(known == len(all_), held).when(known > 0, value)
    return near.select("grid", F.col("ti").alias("i"), F.col("tj").alias("j"), value.alias("value"))
