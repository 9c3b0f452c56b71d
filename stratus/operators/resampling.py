"""Resampling to any times by stacks of algorithms that gaps choose from.

The gap at a time goes from the first row behind the last value before it to the last row ahead of the next value; without such a
value within WINDOW it reaches the series' end. An algorithm runs where the gap is not longer than its ``max_gap``. Of those that
run, the second one's value replaces the first one's; further ones run only while the outcome equals the next row's value.
A value at the very time is taken as it is. Times of a series are distinct; times of a station without rows stay missing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds within which the values around a gap are searched.
WINDOW = 2 * 86_400
#: Two values count as equally near if their distances differ by so many seconds at most.
TIE = 6


class Resample(NamedTuple):
    """``kind`` is linear, nearest or none; seconds: how far apart the values around a time may be, the longest gap."""

    kind: str
    window: int = WINDOW
    extrapolate: bool = False
    max_gap: float | None = None


def _around(obs: DataFrame, asked: DataFrame, station: str, time: str, value: str, us: int) -> DataFrame:
    """``asked`` with p1, the last value before each time, and p2, the next one at or after it, no farther than ``us``, and the series' ends.

    Each has the value beyond it on its side and the time of the row between it and the asked time. After a series' end p2 is its
    last row, if that has a value, and p1 the value before.
    """
    series = Window.partitionBy(station).orderBy(time)
    latest_first = Window.partitionBy(station).orderBy(F.desc(time))
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("x")))
    beyond = lambda w: F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = obs.select(station, time, F.col(value).alias("x"), beyond(series).alias("before"), beyond(latest_first).alias("after"), F.lag(time).over(series).alias("row_before"), F.lead(time).over(series).alias("row_after"))
    rows = rows.where("x IS NOT NULL").select(station, time, F.struct(F.col(time).alias("t"), "x", "before", "after", "row_before", "row_after").alias("p"), F.lit(False).alias("asked"))
    both = rows.unionByName(asked.select(station, time, F.lit(True).alias("asked")), allowMissingColumns=True)
    # windows stay within a slot of time so that one station is not one task; each value also goes to the slots next to its own
    slot = F.floor(F.col(time) / us)
    dealt = both.withColumn("slot", F.explode(F.when(F.col("asked"), F.array(slot)).otherwise(F.array(slot - 1, slot, slot + 1))))
    w = Window.partitionBy(station, "slot").orderBy(time)
    m = Window.partitionBy(station, "slot").orderBy(F.desc(time))
    p1 = F.last("p", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -1))
    p2 = F.last("p", ignorenulls=True).over(m.rangeBetween(Window.unboundedPreceding, 0))
    seen = dealt.select(station, time, "asked", p1.alias("p1"), p2.alias("p2")).where("asked").drop("asked")
    seen = seen.withColumns({"p1": F.when(F.col("p1.t") >= F.col(time) - us, F.col("p1")), "p2": F.when(F.col("p2.t") <= F.col(time) + us, F.col("p2"))})
    ends = obs.groupBy(station).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    seen = seen.join(ends, station, "left")
    late = (F.col(time) > F.col("last")) & (F.col("p1.t") == F.col("last"))
    earlier = F.when(F.col("p1.before").isNotNull(), F.struct(F.col("p1.before.t").alias("t"), F.col("p1.before.x").alias("x"), F.lit(None).cast("struct<t:bigint,x:double>").alias("before"), F.lit(None).cast("struct<t:bigint,x:double>").alias("after"), F.lit(None).cast("long").alias("row_before"), F.col("p1.row_before").alias("row_after")))
    return seen.withColumns({"p2": F.when(late, F.col("p1")).otherwise(F.col("p2")), "p1": F.when(late, F.when(earlier["t"] >= F.col(time) - us, earlier)).otherwise(F.col("p1"))})


def _within(p1: Column, p2: Column, time: Column, us: int) -> tuple[Column, Column]:
    """p1 and p2 as an algorithm with a window of its own finds them: the next value within the window from the last one, if there is one."""
    a = F.when(p1["t"] >= time - us, p1)
    return a, F.when(p2["t"] <= F.coalesce(a["t"], time) + us, p2)


def _value(how: Resample, time: Column, first: Column, last: Column) -> Column:
    if how.kind == "none":
        return F.lit(None).cast("double")
    p1, p2 = _within(F.col("p1"), F.col("p2"), time, how.window * 1_000_000)
    inside = F.lit(True) if how.extrapolate else p1.isNotNull() & p2.isNotNull() & time.between(first, last)
    if how.kind == "nearest":
        d1, d2 = time - p1["t"], p2["t"] - time
        near = F.when(F.abs(d1 - d2) <= TIE * 1_000_000, (p1["x"] + p2["x"]) / 2).when(d1 < d2, p1["x"]).otherwise(p2["x"])
        return F.when(inside, F.when(p1.isNotNull() & p2.isNotNull(), near).otherwise(F.coalesce(p1["x"], p2["x"])))
    if how.kind != "linear":
        raise ValueError(f"no algorithm named {how.kind}")
    # only one side: the value beyond it is the other point
    a, b = (F.when(p1.isNotNull(), p1[c]).otherwise(p2["after"][c]) for c in "tx"), (F.when(p2.isNotNull(), p2[c]).otherwise(p1["before"][c]) for c in "tx")
    (ta, xa), (tb, xb) = a, b
    slope = (xb - xa) / F.nullif((tb - ta).cast("double"), F.lit(0.0))
    return F.when(inside, xb + slope * (time - tb))


def resample(obs: DataFrame, asked: DataFrame, station: str, time: str, value: str, stack: list[Resample], window: int = WINDOW) -> DataFrame:
    """(station, time, value) at the times of ``asked`` by the algorithms of ``stack``; ``window`` is where gaps are searched."""
    us = max([window, *(how.window for how in stack)]) * 1_000_000
    seen = _around(obs, asked, station, time, value, us)
    t, first, last = F.col(time), F.col("first"), F.col("last")
    g1, g2 = _within(F.col("p1"), F.col("p2"), t, window * 1_000_000)
    start = F.when(g1.isNull(), first).otherwise(g1["row_after"])
    end = F.when(g2.isNull(), last).otherwise(g2["row_before"])
    seen = seen.withColumn("gap", F.greatest(F.lit(0), F.coalesce((end - start) / 1e6, F.lit(0))))
    exact = F.col("p2.t") == t
    next_row = F.when(F.coalesce(F.col("p2.row_before") < t, F.lit(True)) | (t > last), F.col("p2.x"))
    out, ran, done = F.lit(None).cast("double"), F.lit(0), F.lit(False)
    for k, how in enumerate(stack):
        runs = ~F.col(f"done{k}") if k else ~done
        if how.max_gap is not None:
            runs = runs & (F.col("gap") <= how.max_gap)
        old, count = (F.col(f"out{k}"), F.col(f"ran{k}")) if k else (out, ran)
        new = F.when(runs, F.coalesce(_value(how, t, first, last), old)).otherwise(old)
        seen = seen.withColumns({f"out{k + 1}": new, f"ran{k + 1}": count + runs.cast("int"), f"runs{k + 1}": runs})
        stop = F.col(f"runs{k + 1}") & (F.col(f"ran{k + 1}") > 1) & ~F.col(f"out{k + 1}").eqNullSafe(next_row)
        seen = seen.withColumn(f"done{k + 1}", stop | (F.col(f"done{k}") if k else done))
    return seen.select(station, time, F.when(exact, F.col("p2.x")).otherwise(F.col(f"out{len(stack)}")).alias(value))
