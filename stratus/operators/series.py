"""Edits, merges and resampling of series, as joins, unions and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def when(time: Column, ranges: list[tuple[int, int]]) -> Column:
    """Closed ranges of microseconds as a predicate."""
    out = F.lit(False)
    for a, b in ranges:
        out = out | time.between(a, b)
    return out


def swap(df: DataFrame, a: str, b: str, where: Column) -> DataFrame:
    return df.withColumns({a: F.when(where, F.col(b)).otherwise(F.col(a)), b: F.when(where, F.col(a)).otherwise(F.col(b))})


def rename(df: DataFrame, sources: list[str], dest: str) -> DataFrame:
    """The first of ``sources`` with a value fills ``dest``; the sources become null."""
    filled = F.coalesce(F.col(dest), *(F.col(s) for s in sorted(sources)))
    return df.withColumn(dest, filled).withColumns({s: F.lit(None).cast(df.schema[s].dataType) for s in sources})


def exclude(df: DataFrame, params: list[str], where: Column) -> DataFrame:
    return df.withColumns({p: F.when(where, None).otherwise(F.col(p)) for p in params})


def keep(df: DataFrame, params: list[str], others: list[str], where: Column) -> DataFrame:
    return exclude(df, [p for p in others if p not in params], where)


def merge(first: DataFrame, second: DataFrame, keys: list[str], time: str, params: list[str], strategy: str = "EXPAND_MERGE", conflicts: str = "PRIORITY_FIRST") -> DataFrame:
    """Joins two sets of series on their times. STRICT_, EXPAND_, FULL_ or WINDOW_MERGE; PRIORITY_FIRST, PRIORITY_LAST or AVERAGE."""
    a = first.select(*keys, time, *(F.col(p).alias(f"a_{p}") for p in params), F.lit(True).alias("in_a"))
    b = second.select(*keys, time, *(F.col(p).alias(f"b_{p}") for p in params))
    both = a.join(b, [*keys, time], "left" if strategy == "STRICT_MERGE" else "full")
    if strategy in ("EXPAND_MERGE", "WINDOW_MERGE"):
        ends = first.groupBy(*keys).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
        both = both.join(ends, keys, "left")
        inside = F.col(time).between(F.col("lo"), F.col("hi"))
        both = both.where((F.col("in_a") | ~inside | F.col("lo").isNull()) if strategy == "EXPAND_MERGE" else inside)
    pick = {
        "PRIORITY_FIRST": lambda x, y: F.coalesce(x, y),
        "PRIORITY_LAST": lambda x, y: F.coalesce(y, x),
        "AVERAGE": lambda x, y: F.coalesce((x + y) / 2, x, y),
    }[conflicts]
    return both.select(*keys, time, *(pick(F.col(f"a_{p}"), F.col(f"b_{p}")).alias(p) for p in params))


def merge_all(sets: list[DataFrame], keys: list[str], time: str, params: list[str], strategy: str = "EXPAND_MERGE", conflicts: str = "PRIORITY_FIRST") -> DataFrame:
    """Merges a list of sets into its first one, in the order given."""
    out = sets[0]
    for more in sets[1:]:
        out = merge(out, more, keys, time, params, strategy, conflicts)
    return out


def create(df: DataFrame, param: str, value: Column, where: Column | None = None) -> DataFrame:
    """A parameter that is not there, or the missing values of one that is, from ``value``; elsewhere than ``where`` it stays missing."""
    new = value if where is None else F.when(where, value)
    return df.withColumn(param, F.coalesce(F.col(param), new) if param in df.columns else new)


def metadata(df: DataFrame, changes: dict[str, Column], where: Column) -> DataFrame:
    """Station columns (name, coordinates, slope, ...) replaced by ``changes`` in the rows of ``where``."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in changes.items()})


def automerge(df: DataFrame, keys: list[str], priority: str, params: list[str]) -> DataFrame:
    """One row per key: of each parameter the value of the smallest ``priority`` that has one."""
    return df.groupBy(*keys).agg(*(F.min_by(p, F.when(F.col(p).isNotNull(), F.col(priority))).alias(p) for p in params))


def regression_fill(target: DataFrame, source: DataFrame, keys: list[str], time: str, param: str) -> DataFrame:
    """Adds the source's times that the target lacks, predicted by the line fitted on the common ones.

    A target whose times are all in the source stays as it is.
    """
    a, b = target.select(*keys, time, F.col(param).alias("y")), source.select(*keys, time, F.col(param).alias("x"))
    common = a.join(b, [*keys, time])
    fit = common.groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("icept"), F.count(F.lit(1)).alias("n"))
    fit = fit.join(a.groupBy(*keys).agg(F.count(F.lit(1)).alias("all")), keys).where("n < all").drop("n", "all")
    new = b.join(a, [*keys, time], "left_anti").join(fit.where("slope IS NOT NULL"), keys)
    return target.select(*keys, time, param).unionByName(new.select(*keys, time, (F.col("slope") * F.col("x") + F.col("icept")).alias(param)))


def grid_of(obs: DataFrame, station: str, time: str, step_us: int) -> DataFrame:
    """(station, time): every multiple of ``step_us`` between a station's first and last row."""
    ends = obs.groupBy(station).agg(F.ceil(F.min(time) / step_us).cast("long").alias("a"), F.floor(F.max(time) / step_us).cast("long").alias("b")).where("a <= b")
    return ends.select(station, F.explode(F.sequence("a", "b")).alias("k")).select(station, (F.col("k") * step_us).alias(time))


def around(obs: DataFrame, grid: DataFrame, station: str, time: str, value: str, window_us: int) -> DataFrame:
    """Grid times with the last value at or before (t1, x1) and the first one at or after (t2, x2), each within the window."""
    there = obs.where(F.col(value).isNotNull()).select(station, time, F.col(value).alias("x"), F.lit(False).alias("asked"))
    both = there.unionByName(grid.select(station, time, F.lit(None).cast("double").alias("x"), F.lit(True).alias("asked")))
    point = F.when(~F.col("asked"), F.struct(F.col(time).alias("t"), F.col("x").alias("x")))
    # windows stay within (station, slot of time) so that one station is not one task; each row also goes to both next slots
    slot = F.floor(F.col(time) / F.lit(max(window_us, 1)))
    dealt = both.withColumn("slot", F.explode(F.when(F.col("asked"), F.array(slot)).otherwise(F.array(slot - 1, slot, slot + 1))))
    w = Window.partitionBy(station, "slot").orderBy(time)
    before = F.last(point, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    latest_first = Window.partitionBy(station, "slot").orderBy(F.desc(time))
    after = F.last(point, ignorenulls=True).over(latest_first.rangeBetween(Window.unboundedPreceding, 0))
    seen = dealt.select(station, time, "asked", before.alias("p1"), after.alias("p2")).where("asked")
    p1 = F.when(F.col("p1.t") >= F.col(time) - window_us, F.col("p1"))
    p2 = F.when(F.col("p2.t") <= F.col(time) + window_us, F.col("p2"))
    return seen.select(station, time, p1["t"].alias("t1"), p1["x"].alias("x1"), p2["t"].alias("t2"), p2["x"].alias("x2"))


def resample_linear(obs: DataFrame, grid: DataFrame, station: str, time: str, value: str, window_us: int) -> DataFrame:
    """Line between the neighbours; null if one is missing or they are over a window apart."""
    a = around(obs, grid, station, time, value, window_us)
    line = F.col("x1") + (F.col("x2") - F.col("x1")) * (F.col(time) - F.col("t1")) / (F.col("t2") - F.col("t1"))
    return a.select(station, time, F.when(F.col("t1") == F.col("t2"), F.col("x1")).when(F.col("t2") - F.col("t1") <= window_us, line).alias(value))


def resample_nearest(obs: DataFrame, grid: DataFrame, station: str, time: str, value: str, window_us: int, tie_us: int = 6_000_000) -> DataFrame:
    """The closer neighbour; the mean if their distances differ by ``tie_us`` at most."""
    a = around(obs, grid, station, time, value, window_us)
    d1, d2 = F.col(time) - F.col("t1"), F.col("t2") - F.col(time)
    near = F.when(F.col("t1") == F.col("t2"), F.col("x1")).when(F.abs(d1 - d2) <= tie_us, (F.col("x1") + F.col("x2")) / 2).when(d1 < d2, F.col("x1")).otherwise(F.col("x2"))
    return a.select(station, time, F.when(d1.isNotNull() & d2.isNotNull(), near).alias(value))


def accumulate(obs: DataFrame, station: str, time: str, value: str, step_us: int) -> DataFrame:
    """Sums over (t - step, t] at every multiple t of ``step_us``. A value belongs to the time since the row before it and is dealt
    in proportion; missing values add nothing, the first row of a series has no such time. One row for each time that has a share."""
    before = F.lag(time).over(Window.partitionBy(station).orderBy(time))
    spans = obs.select(station, F.col(time).alias("b"), F.col(value).alias("x"), before.alias("a")).where("x IS NOT NULL AND a < b")
    dealt = spans.withColumn("k", F.explode(F.sequence(F.floor(F.col("a") / step_us), F.floor((F.col("b") - 1) / step_us))))
    share = (F.least(F.col("b"), (F.col("k") + 1) * step_us) - F.greatest(F.col("a"), F.col("k") * step_us)) / (F.col("b") - F.col("a"))
    return dealt.groupBy(station, ((F.col("k") + 1) * step_us).cast("long").alias(time)).agg(F.sum(F.col("x") * share).alias(value))


def daily_average(obs: DataFrame, grid: DataFrame, station: str, time: str, value: str, reach: float, phase: float = 0.0) -> DataFrame:
    """Values at the times of ``grid`` from one value a day: a daily sinusoid of amplitude ``reach`` around the day's value.

    The days before and after weigh in by the squared distance of the time to their noons. Midnight belongs to the day that
    ends there; several values of a day count as their mean, and times of days without a value are null.
    """
    day_us = 86_400_000_000
    day = F.floor((F.col(time) - 1) / day_us).cast("long")
    days = obs.where(F.col(value).isNotNull()).groupBy(station, day.alias("day")).agg(F.avg(value).alias("v1"))
    w = Window.partitionBy(station).orderBy("day")
    days = days.withColumns({"v0": F.max("v1").over(w.rangeBetween(-1, -1)), "v2": F.max("v1").over(w.rangeBetween(1, 1))})
    both = grid.withColumn("day", day).join(days, [station, "day"], "left").withColumn("part", (F.col(time) - F.col("day") * day_us) / day_us)
    part, total, norm = F.col("part"), F.lit(0.0), F.lit(0.0)
    for v, noon in (("v0", -0.5), ("v1", 0.5), ("v2", 1.5)):
        weight = 1 / F.nullif(F.pow(part - noon, 2), F.lit(0.0))
        total = total + F.coalesce(weight * F.col(v), F.lit(0.0))
        norm = norm + F.when(F.col(v).isNotNull(), F.coalesce(weight, F.lit(0.0))).otherwise(0.0)
    mean = F.when(part == 0.5, F.col("v1")).otherwise(total / F.nullif(norm, F.lit(0.0)))
    return both.select(station, time, F.when(F.col("v1").isNotNull(), mean + reach * F.sin(2 * math.pi * (part - 0.25 + phase))).alias(value))


def suppress(df: DataFrame, time: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Without the rows of closed ranges of microseconds."""
    return df.where(~when(F.col(time), ranges))


def shift_steps(time: Column, steps: list[tuple[int, float]]) -> Column:
    """Times moved by the seconds of the last step (start in microseconds, seconds) at or before them; none before the first."""
    moved = F.lit(0.0)
    for start, seconds in sorted(steps):
        moved = F.when(time >= start, F.lit(float(seconds))).otherwise(moved)
    return time + (moved * 1_000_000).cast("long")


def time_loop(df: DataFrame, time: str, reference: tuple[int, int], wanted: tuple[int, int]) -> DataFrame:
    """The rows of the reference period [a, b) again and again, wherever their times fall into the closed range ``wanted``."""
    (a, b), (lo, hi) = reference, wanted
    first, last = F.ceil((lo - F.col(time)) / (b - a)).cast("long"), F.floor((hi - F.col(time)) / (b - a)).cast("long")
    again = df.where((F.col(time) >= a) & (F.col(time) < b)).where(last >= first)
    return again.withColumn("again", F.explode(F.sequence(first, last))).withColumn(time, F.col(time) + F.col("again") * (b - a)).drop("again")
