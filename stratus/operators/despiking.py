"""Spikes of series in phase space (value, first and second derivative), found and replaced round by round.

All series run their rounds together, and a round carries only those that still change: it deletes the tables of the round before and keeps
the rows of series that ended. Rows are numbered by counts of parts of their time, so a series is never one task: derivatives are solved in runs of RUN rows with a margin as wide as they look, the ellipses come from one
aggregate for each series, and a spike meets the good rows beside it by their number.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratus.operators.runs import numbered
from stratus.operators.saved import over, saved

#: Rows of a run in one task.
RUN = 65_536
#: Rows that a derivative looks to each side at most, rounds at most.
REACH, ROUNDS = 101, 50


def derivative(u: np.ndarray, t: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Slope between the nearest two rows, as many rows before a row as behind it, that both have a value; NaN where there are none or the row has none.

    Where one side leaves the series (rows are numbered ``n``, 1 to ``size``), the row itself stands in for it and the search ends. Rows
    nearer to an end of the arrays than REACH, which is no end of the series, are not exact.
    """
    here, out = np.arange(len(u)), np.full(len(u), np.nan)
    open_ = ~np.isnan(u)
    for k in range(1, REACH + 1):
        i = here[open_]
        if not len(i):
            break
        before, behind = n[i] - k < 1, n[i] + k > size
        a, b = np.where(before, i, np.maximum(i - k, 0)), np.where(behind, i, np.minimum(i + k, len(u) - 1))
        known = ~np.isnan(u[a]) & ~np.isnan(u[b])
        end = before | behind | known
        use = known & (t[a] != t[b])
        out[i[use]] = (u[b] - u[a])[use] / (t[b] - t[a])[use]
        open_[i[end]] = False
    return out


def _series(numbers: DataFrame) -> DataFrame:
    """(s, us, n, size, t, x): rows of a series numbered from 1, times from the first one in steps to the second."""
    first = numbers.where("n <= 2").groupBy("s").agg(F.min("us").alias("t0"), F.nullif(F.max("us") - F.min("us"), F.lit(0)).alias("dt"))
    return numbers.join(first, "s").select("s", "us", "n", "size", ((F.col("us") - F.col("t0")) / F.coalesce("dt", F.lit(1))).alias("t"), "x")


def _derived(state: DataFrame) -> DataFrame:
    """``state`` with its run and both derivatives."""
    margin = 2 * REACH
    run = lambda c: F.floor(c / RUN).cast("long")
    n = F.col("n") - 1
    dealt = state.withColumn("run", F.explode(F.sequence(run(F.greatest(n - margin, F.lit(0))), run(F.least(n + margin, F.col("size") - 1)))))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        u, t, n, size = (pdf[c].to_numpy(float) for c in ("x", "t", "n", "size"))
        du = derivative(u, t, n, size[0])
        out = pdf.assign(du=du, d2=derivative(du, t, n, size[0]))
        return out[(out["n"] - 1) // RUN == out["run"]]

    kind = state.schema["s"].dataType.simpleString()
    out = dealt.groupBy("s", "run").applyInPandas(solve, f"s {kind}, us long, n long, size long, t double, x double, run long, du double, d2 double")
    none = F.lit(None).cast("double")
    return out.withColumns({c: F.nanvl(c, none) for c in ("x", "du", "d2")})


def _spikes(d: DataFrame, method: str, sensitivity: float) -> DataFrame:
    """``d`` with the column spike."""
    both = lambda c: F.when(F.col("d2").isNotNull(), F.col(c))
    of = d.groupBy("s").agg(
        F.count("x").alias("nx"), F.avg("x").alias("mean"), F.var_samp("x").alias("vx"), F.var_samp("du").alias("v1"), F.var_samp("d2").alias("v2"), F.covar_samp(both("x"), both("d2")).alias("cov"),
        F.count("d2").alias("n2"), F.avg("d2").alias("m2"), F.avg(both("x")).alias("mb"), F.var_samp(both("x")).alias("vb"), F.var_samp(both("du")).alias("v1b"),
    )
    c = F.col
    product = F.coalesce(c("cov") * (c("n2") - 1), F.lit(0.0)) + c("n2") * c("m2") * (c("mb") - c("mean"))
    theta = F.atan(product / F.nullif(c("vx") * (c("nx") - 1), F.lit(0.0)))
    of = of.withColumns({"k": 2 * F.ln("nx") / sensitivity**2, "co": F.cos(theta), "si": F.sin(theta)})
    u, du, d2, co, si = c("x") - c("mean"), c("du"), c("d2"), c("co"), c("si")

    def outside(*terms: tuple[Column, Column]) -> Column:
        """Beyond the ellipsoid of these squared axes; nothing is where an axis is no positive number."""
        there = reduce(lambda a, b: a & b, (axis > 0 for _, axis in terms))
        return F.coalesce(F.when(there, sum((x * x / F.nullif(axis, F.lit(0.0)) for x, axis in terms), F.lit(0.0)) > 1), F.lit(False))

    if method == "MORI":
        of = of.withColumns({"ax": c("k") * (co * co * c("vb") + si * si * c("v2") + 2 * si * co * c("cov")), "az": c("k") * (si * si * c("vb") + co * co * c("v2") - 2 * si * co * c("cov")), "ay": c("k") * c("v1b")})
        spike = outside((u * co + d2 * si, c("ax")), (du, c("ay")), (d2 * co - u * si, c("az")))
    elif method == "GORING":
        across = F.nullif(F.pow(co, F.lit(4.0)) - F.pow(si, F.lit(4.0)), F.lit(0.0))
        a, b = c("k") * c("vx"), c("k") * c("v2")
        of = of.withColumns({"a3": (a * co * co - si * si * b) / across, "b3": (co * co * b - a * si * si) / across})
        first, second = outside((u, a), (du, c("k") * c("v1"))), outside((du, c("k") * c("v1")), (d2, b))
        third = outside((u * co + d2 * si, c("a3")), (u * si - d2 * co, c("b3")))
        spike = F.coalesce((c("vx") > 0) & (c("v1") > 0) & (c("v2") > 0), F.lit(False)) & (first | second | third)
    else:
        raise ValueError("the method is GORING or MORI")
    return d.join(of, "s").withColumn("spike", c("x").isNotNull() & spike).select(*d.columns, "spike")


def _fitted(flagged: DataFrame, degree: int, points: int) -> DataFrame:
    """(s, n, fit): the spikes' values by polynomials through half of ``points`` good rows on each side, where both sides have one and all are enough."""
    half = points // 2
    good = F.col("x").isNotNull() & ~F.col("spike")
    runs = flagged.groupBy("s", "run").agg(F.count_if(good).alias("count"))
    runs = runs.withColumn("before", F.sum("count").over(Window.partitionBy("s").orderBy("run")) - F.col("count")).drop("count")
    inside = Window.partitionBy("s", "run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    counted = flagged.join(runs, ["s", "run"]).withColumn("g", F.col("before") + F.count_if(good).over(inside))
    asked = counted.where("spike").select("s", "n", F.col("t").alias("at"), F.explode(F.sequence(F.greatest(F.col("g") - half + 1, F.lit(1)), F.col("g") + half)).alias("g"))
    near = asked.join(counted.where(good).select("s", "g", (F.col("t")).alias("t"), "x"), ["s", "g"])
    lists = near.groupBy("s", "n").agg(F.sort_array(F.collect_list(F.struct((F.col("t") - F.col("at")).alias("t"), "x"))).alias("p"))
    lists = lists.where((F.size("p") > degree) & (F.col("p")[0]["t"] < 0) & (F.element_at("p", -1)["t"] > 0))

    def fit(batches):
        for pdf in batches:
            at_zero = [float(np.polynomial.polynomial.polyfit([q["t"] for q in p], [q["x"] for q in p], degree)[0]) for p in pdf["p"]]
            yield pdf[["s", "n"]].assign(fit=np.array(at_zero, float))

    return lists.mapInPandas(fit, f"s {flagged.schema['s'].dataType.simpleString()}, n long, fit double")


def despike(rows: DataFrame, station: str, time: str, value: str, method: str = "GORING", sensitivity: float = 1.0, degree: int = 3, points: int = 24, block_us: int | None = None) -> DataFrame:
    """(station, time, value) without spikes: replaced by a polynomial of ``degree`` through ``points`` rows around, or missing with degree 0.

    A series ends when a round finds no spike or does not lower its standard deviation, or after ROUNDS. Missing values stay missing; a spike
    without good rows on both sides stays. Times (in microseconds) of a series are distinct; its rows are numbered in parts of ``block_us``, or of
    as much time as an average run. Ellipses without extent, as those of constant series, find nothing.
    """
    known = rows.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")))
    numbers = numbered(known, station, time, value, block_us).select("s", F.col("t").alias("us"), (F.col("n") + 1).alias("n"), "size", F.col("v").alias("x"))
    held = saved(numbers, "numbered")
    state, moves, done = _series(held), None, []
    for left in range(ROUNDS - 1, -1, -1):
        derived = saved(_derived(state), "derived")
        over(held, moves)
        flagged = _spikes(derived, method, sensitivity)
        if degree > 0:
            new = flagged.join(_fitted(flagged, degree, points), ["s", "n"], "left").withColumn("y", F.when(F.col("spike") & F.col("fit").isNotNull(), F.col("fit")).otherwise(F.col("x")))
        else:
            new = flagged.withColumn("y", F.when(~F.col("spike"), F.col("x")))
        held = saved(new.select("s", "us", "n", "size", "t", "x", "y", "spike"), "round")
        del flagged, new
        over(derived)
        moves = saved(held.groupBy("s").agg((F.max("spike") & (F.stddev_samp("y") < F.stddev_samp("x"))).alias("moves")), "moves")
        after = held.select("s", "us", "n", "size", "t", F.col("y").alias("x"))
        if not left or moves.where("moves").isEmpty():
            done.append(after.select("s", "us", "x"))
            over(moves)
            break
        moving = moves.where("moves").select("s")
        if not moves.where("moves IS NULL OR NOT moves").isEmpty():
            done.append(saved(after.join(moving, "s", "left_anti").select("s", "us", "x"), "ended"))
        state = after.join(moving, "s", "left_semi")
    return reduce(DataFrame.unionByName, done).select(F.col("s").alias(station), F.col("us").alias(time), F.col("x").alias(value))
