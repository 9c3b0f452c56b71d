"""Window frames of at least ``points`` rows and at least ``seconds`` of time, and filters on them.

A frame reaches back over ``points`` - 1 rows or to the last row at or before ``seconds`` ago, whichever is farther; a right frame is
its mirror image, a centred one takes half of both on each side and holds only if both sides have as many rows. A hard frame is
missing where the series has not enough of either. A soft one then takes the first (right: last) rows of the series that are
enough. Times of a series are distinct. For any statistic (``framed``), each frame is one of two of Spark's own, by rows or by time with the
row before it, so no row is joined to its neighbours; frames at the ends are one of two groups of rows for each series. That costs as much
as all frames are long together. The filters take runs of rows with what their frames reach beyond them instead: first and last row
by search, moments by sums, medians by a wavelet matrix, so a row costs the same in a long frame as in a short one, but for logarithms.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stratus.operators.runs import known, packed, replaced, together, with_reach
from stratus.operators.saved import saved


class Statistic(NamedTuple):
    """What is known of a frame's values: an aggregate, and how one more value changes it. Null values don't count."""

    of: Callable[[Column], dict[str, Column]]
    plus: Callable[[Column, Column], Column]

    def over(self, x: Column, w: WindowSpec) -> Column:
        return F.struct(*(c.over(w).alias(k) for k, c in self.of(x).items()))

    def grouped(self, x: Column) -> Column:
        return F.struct(*(c.alias(k) for k, c in self.of(x).items()))

    def with_value(self, known: Column, x: Column) -> Column:
        return F.when(x.isNull(), known).otherwise(self.plus(known, x))


def _moments_plus(s: Column, x: Column) -> Column:
    n = s["n"] + 1
    mean = F.coalesce(s["mean"], x) + (x - F.coalesce(s["mean"], x)) / n
    spread = (F.coalesce(s["var"], F.lit(0.0)) * s["n"] + (x - F.coalesce(s["mean"], x)) * (x - mean)) / n
    return F.struct(n.alias("n"), mean.alias("mean"), spread.alias("var"))


MOMENTS = Statistic(lambda x: {"n": F.count(x), "mean": F.avg(x), "var": F.var_pop(x)}, _moments_plus)
VALUES = Statistic(lambda x: {"values": F.collect_list(x)}, lambda s, x: F.struct(F.concat(s["values"], F.array(x)).alias("values")))


def _one_sided(stat: Statistic, x: Column, clock: Column, series: WindowSpec, points: int, us: int) -> tuple[Column, Column, Column]:
    """(statistic of the hard frame behind each row, its rows before the row by the time criterion or null, rows before the row)."""
    early = series.rangeBetween(Window.unboundedPreceding, -us)
    before = F.row_number().over(series) - 1
    by_time = before - (F.count(F.lit(1)).over(early) - 1)
    at_start = F.last(F.struct(clock.alias("t"), x.alias("x"))).over(early)
    timed = stat.over(x, series.rangeBetween(-us, 0))
    timed = F.when(at_start["t"] < clock - us, stat.with_value(timed, at_start["x"])).otherwise(timed)
    counted = stat.over(x, series.rowsBetween(-(points - 1), 0))
    reach = F.when(at_start.isNotNull(), by_time)
    return F.when(reach.isNotNull() & (before >= points - 1), F.when(reach <= points - 1, counted).otherwise(timed)), reach, before


def framed(df: DataFrame, station: str, time: str, value: str, stat: Statistic, centering: str = "center", points: int = 1, seconds: int = 0, soft: bool = False, name: str = "frame") -> DataFrame:
    """``df`` with the column ``name``: ``stat`` of ``value`` in the frame of each row, null where there is none.

    ``centering`` is where the frame lies: left, right or center; ``time`` is in microseconds. Centred frames are hard.
    """
    if points < 1 or centering not in ("left", "right", "center") or (soft and centering == "center"):
        raise ValueError("a frame needs a point, and is left, right or (hard only) center")
    us, x = seconds * 1_000_000, F.col(value)
    if centering == "center":
        return _centred(df, station, time, x, stat, points, us, name)
    clock = F.col(time) if centering == "left" else -F.col(time)
    series = Window.partitionBy(station).orderBy("clock_")
    rows = df.withColumn("clock_", clock)
    hard, reach, before = _one_sided(stat, x, F.col("clock_"), series, points, us)
    rows = rows.withColumns({name: hard, "reach_": reach, "before_": before})
    if not soft:
        return rows.drop("clock_", "reach_", "before_")
    whole = Window.partitionBy(station)
    rows = rows.withColumns({"first_": F.min("clock_").over(whole), "rows_": F.count(F.lit(1)).over(whole)})
    # rows that one span from the end of the series reaches: up to its first row at or after that
    short = F.sum(F.when(F.col("clock_") < F.col("first_") + us, 1).otherwise(0)).over(whole)
    if centering == "left":
        spanned = F.least(short + 1, F.col("rows_"))
    else:
        # and the row beyond it, unless the row itself is the last within the span; none if the whole series is within it
        last_in = F.max(F.when(F.col("clock_") <= F.col("first_") + us, F.col("before_"))).over(whole)
        spanned = F.when(last_in + 1 < F.col("rows_"), F.when(F.col("before_") == last_in, last_in + 1).otherwise(last_in + 2))
    wanted = F.when(F.col("reach_").isNotNull(), points).when(spanned.isNotNull(), F.greatest(spanned, F.lit(points)))
    rows = rows.withColumn("wanted_", F.when(F.col(name).isNull() & (wanted <= F.col("rows_")), wanted))
    lengths = rows.select(station, "wanted_").where("wanted_ IS NOT NULL").distinct()  # three of a series at most
    ends = rows.select(F.col(station).alias("s_"), "before_", x.alias("x_")).join(lengths.withColumnRenamed(station, "s2_"), (F.col("s_") == F.col("s2_")) & (F.col("before_") < F.col("wanted_")))
    ends = ends.groupBy(F.col("s_").alias(station), F.col("wanted_")).agg(stat.grouped(F.col("x_")).alias("end_"))
    out = rows.join(ends, [station, "wanted_"], "left").withColumn(name, F.coalesce(name, "end_"))
    return out.select(*df.columns, name)


def _centred(df: DataFrame, station: str, time: str, x: Column, stat: Statistic, points: int, us: int, name: str) -> DataFrame:
    half, side = us // 2, points // 2
    rows = df.withColumns({"clock_": F.col(time), "mirror_": -F.col(time)})
    w, m = Window.partitionBy(station).orderBy("clock_"), Window.partitionBy(station).orderBy("mirror_")

    def reach(series: WindowSpec, clock: str) -> tuple[Column, Column, Column]:
        early = series.rangeBetween(Window.unboundedPreceding, -half)
        before, there = F.row_number().over(series) - 1, F.count(F.lit(1)).over(early)
        return before, F.when(there > 0, before - (there - 1)), F.last(F.struct(F.col(clock).alias("t"), x.alias("x"))).over(early)

    (b, left, far_left), (a, right, far_right) = reach(w, "clock_"), reach(m, "mirror_")
    timed = stat.over(x, w.rangeBetween(-half, half))
    for far, clock in ((far_left, "clock_"), (far_right, "mirror_")):
        timed = F.when(far["t"] < F.col(clock) - half, stat.with_value(timed, far["x"])).otherwise(timed)
    counted = stat.over(x, w.rowsBetween(-side, side))
    whole = left.isNotNull() & right.isNotNull() & (b >= side) & (a >= side) & (F.greatest(left, F.lit(side)) == F.greatest(right, F.lit(side)))
    return rows.withColumn(name, F.when(whole, F.when(F.greatest(left, F.lit(side)) == side, counted).otherwise(timed))).select(*df.columns, name)


def bounds(t: np.ndarray, first: int, own: slice, size: int, lo: int, hi: int, centering: str, points: int, us: int, soft: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(there is a frame, its first row, its last row) of the rows ``own`` of ``t``, whose rows are numbers ``first`` and on of a series of ``size`` from ``lo`` to ``hi``."""
    at, i = t[own], np.arange(own.start, own.stop) + first
    before = lambda far: (at - far >= lo, first + np.searchsorted(t, at - far, "right") - 1)
    behind = lambda far: (at + far <= hi, first + np.searchsorted(t, at + far, "left"))
    if centering == "center":
        (left, a), (right, b) = before(us // 2), behind(us // 2)
        side = points // 2
        reach = np.maximum(i - a, side)
        there = left & right & (i >= side) & (i + side < size) & (reach == np.maximum(b - i, side))
        return there, i - reach, i + reach
    if centering == "left":
        timed, a = before(us)
        start = np.minimum(np.where(timed, a, 0), np.maximum(i - points + 1, 0))
        if not soft:
            return timed & (i >= points - 1), start, i
        head = first + np.searchsorted(t, lo + us, "left") if lo + us <= hi else size - 1
        end = np.maximum(np.where(timed, i, np.maximum(head, i)), start + points - 1)
        return end < size, start, end
    timed, b = behind(us)
    end = np.maximum(np.where(timed, b, size - 1), np.minimum(i + points - 1, size - 1))
    if not soft:
        return timed & (i + points <= size), i, end
    tail = first + np.searchsorted(t, hi - us, "left") if hi - us >= lo else 0
    start = np.minimum(np.where(timed | (tail == i), i, tail - 1), end - points + 1)
    return (start >= 0) & (timed | (tail > 0)), start, end


def _kept(df: DataFrame, station: str, time: str, value: str, kinds: dict[str, tuple[str, bool]], points: int, seconds: int, far: Callable, strict: Callable[[bool], bool]) -> DataFrame:
    """(station, time, kind, value): each row for each of ``kinds`` (centering, soft), null if ``far`` says so, or without a frame if ``strict`` of soft."""
    if points < 1 or any(c not in ("left", "right", "center") or (soft and c == "center") for c, soft in kinds.values()):
        raise ValueError("a frame needs a point, and is left, right or (hard only) center")
    us = seconds * 1_000_000
    runs = saved(packed(df, station, time, value), "runs")
    kind = runs.schema["s"].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        t, x, first, own = together(pdf)
        size, lo, hi = (int(pdf[c].iat[0]) for c in ("size", "lo", "hi"))
        values, mine, out = x[~np.isnan(x)], x[own], []
        count = np.concatenate([[0], np.cumsum(~np.isnan(x))])
        for name, (centering, soft) in kinds.items():
            there, a, b = bounds(t, first, own, size, lo, hi, centering, points, us, soft)
            a, b = (count[np.where(there, c - first, 0)] for c in (a, b + 1))
            asked = np.flatnonzero(there & ~np.isnan(mine))
            gone = ~there if strict(soft) else np.zeros(len(mine), bool)
            gone[asked] = far(values, a[asked], b[asked], mine[asked], soft)
            out.append(pd.DataFrame({"s": pdf["s"].iat[0], "t": t[own], "kind": name, "v": np.where(gone, np.nan, mine)}))
        return pd.concat(out)

    # a microsecond more, for the row before the last one that is a span away
    out = with_reach(runs, points, us + 1).groupBy("s", "r0").applyInPandas(solve, f"s {kind}, t long, kind string, v double")
    return out.select(F.col("s").alias(station), F.col("t").alias(time), "kind", known(F.col("v")).alias(value))


def far_from_mean(values: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray, sigma: float) -> np.ndarray:
    """Whether ``x`` is beyond ``sigma`` deviations from the mean of ``values`` a to b (exclusive); where sums cannot tell, from the values themselves. False without two of them."""
    n = b - a
    middle = values - (values[len(values) // 2] if len(values) else 0.0)
    one, two = (np.concatenate([[0], np.cumsum(c)]) for c in (middle.astype(np.longdouble), middle.astype(np.longdouble) ** 2))
    several = np.maximum(n, 2)
    mean = (one[b] - one[a]) / several
    spread = sigma * sigma * np.maximum(two[b] - two[a] - mean * mean * n, 0) / (several - 1)
    off = (x - (values[len(values) // 2] if len(values) else 0.0) - mean) ** 2
    out = (off > spread) & (n > 1)
    # sums of up to two[-1] are off by less than this
    doubt = (np.abs(off - spread) <= 1e-12 * off + 1e-16 * (1 + sigma * sigma) * two[-1] / several) & (n > 1)
    changes = np.concatenate([[0, 0], np.cumsum(values[1:] != values[:-1])])
    same = doubt & (changes[b] == changes[np.minimum(a + 1, len(values))])
    out[same] = False
    for i in np.flatnonzero(doubt & ~same):
        frame = values[a[i] : b[i]]
        out[i] = abs(x[i] - frame.mean()) > sigma * frame.std(ddof=1)
    return out


class Ordered:
    """The values of any stretch of an array in order, by a wavelet matrix of their ranks: a value takes as many steps as their number has bits."""

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        ranks = np.empty(len(values), np.int32)
        ranks[order] = np.arange(len(values), dtype=np.int32)
        self.levels = []
        for bit in reversed(range(max(1, len(values) - 1).bit_length())):
            ones = (ranks >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(ones == 0, dtype=np.int32)]).astype(np.int32)
            self.levels.append((bit, zeros))
            ranks = np.concatenate([ranks[ones == 0], ranks[ones == 1]])

    def at(self, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The values at places ``k``, from 0, of the ordered stretches a to b (exclusive)."""
        a, b, k, rank = a.astype(np.int32), b.astype(np.int32), k.astype(np.int32), np.zeros(len(a), np.int32)
        for bit, zeros in self.levels:
            za, zb = zeros[a], zeros[b]
            one = k >= zb - za
            k -= np.where(one, zb - za, 0)
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
            rank |= one.astype(np.int32) << bit
        return self.sorted[rank]


def far_from_median(values: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray, min_sigma: float) -> np.ndarray:
    """Whether ``x`` is beyond three robust deviations from the median of ``values`` a to b (exclusive); false without values."""
    out, some = np.zeros(len(x), bool), np.flatnonzero(b > a)
    if not len(some):
        return out
    ordered, a, b, x = Ordered(values), a[some], b[some], x[some]
    n = b - a
    middle = (ordered.at(a, b, (n - 1) // 2) + ordered.at(a, b, n // 2)) / 2
    # the deviation only matters beyond its least
    beyond = np.flatnonzero(np.abs(x - middle) > 3 * min_sigma)
    a, b, n, x, middle = (c[beyond] for c in (a, b, n, x, middle))
    k = (n - 1) // 2
    # the k + 1 values closest to the median lie together from place low or from the place before it; low is the first whose far end is as far as its near one
    low, high = np.zeros(len(n), np.int64), n - k
    while (open_ := np.flatnonzero(low < high)).size:
        at = (low[open_] + high[open_]) // 2
        s = (a[open_], b[open_])
        done = at >= n[open_] - k[open_]
        at_most = np.minimum(at, n[open_] - k[open_] - 1)
        right = done | (ordered.at(*s, at_most + k[open_]) - middle[open_] >= middle[open_] - ordered.at(*s, at_most))
        high[open_[right]], low[open_[~right]] = at[right], at[~right] + 1

    def off(place: np.ndarray) -> np.ndarray:
        """Distance of the value at a place, infinite outside of the frame."""
        inside = (place >= 0) & (place < n)
        return np.where(inside, np.abs(ordered.at(a, b, np.clip(place, 0, n - 1)) - middle), np.inf)

    from_low, from_before = np.where(low + k < n, off(low + k), np.inf), np.where(low > 0, off(low - 1), np.inf)
    begin = np.where(from_low <= from_before, low, low - 1)
    nearest = np.minimum(from_low, from_before)
    following = np.minimum(off(begin - 1), off(begin + k + 1))
    spread = np.where(n % 2 == 1, nearest, (nearest + np.where(n % 2 == 1, 0.0, following)) / 2)
    out[some[beyond]] = np.abs(x - middle) > 3 * np.maximum(spread / 0.6745, min_sigma)
    return out


def std_devs(df: DataFrame, station: str, time: str, value: str, kinds: dict[str, tuple[str, bool]], sigma: float = 2.0, points: int = 1, seconds: int = 0) -> DataFrame:
    """(station, time, kind, value) of ``std_dev`` for several frames at once: ``kinds`` are their (centering, soft) by name."""
    return _kept(df, station, time, value, kinds, points, seconds, lambda v, a, b, x, soft: far_from_mean(v, a, b, x, sigma) | ((b - a < 2) & (not soft)), lambda soft: not soft)


def std_dev(df: DataFrame, station: str, time: str, value: str, sigma: float = 2.0, centering: str = "center", points: int = 1, seconds: int = 0, soft: bool = False) -> DataFrame:
    """``value`` is null beyond ``sigma`` deviations from its frame's mean; without a frame of two values too, unless it is soft. NaN counts as missing."""
    return replaced(df, station, time, value, std_devs(df, station, time, value, {"": (centering, soft)}, sigma, points, seconds).drop("kind"))


def mads(df: DataFrame, station: str, time: str, value: str, kinds: dict[str, tuple[str, bool]], min_sigma: float = 0.0, points: int = 1, seconds: int = 0, strict: bool = False) -> DataFrame:
    """(station, time, kind, value) of ``mad`` for several frames at once: ``kinds`` are their (centering, soft) by name."""
    return _kept(df, station, time, value, kinds, points, seconds, lambda v, a, b, x, _: far_from_median(v, a, b, x, min_sigma), lambda _: strict)


def mad(df: DataFrame, station: str, time: str, value: str, min_sigma: float = 0.0, centering: str = "center", points: int = 1, seconds: int = 0, soft: bool = False, strict: bool = False) -> DataFrame:
    """``value`` is null beyond three robust deviations from its frame's median, and without a frame if ``strict``. NaN counts as missing."""
    return replaced(df, station, time, value, mads(df, station, time, value, {"": (centering, soft)}, min_sigma, points, seconds, strict).drop("kind"))
