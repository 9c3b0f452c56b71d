"""Value filters of a station's series: ``Column`` in, ``Column`` out; null stays null.

``over`` gives the window of a station's series in time order; statistics skip nulls, bounds count all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(*station: str, time: str = "t_us") -> WindowSpec:
    return Window.partitionBy(*station).orderBy(time)


def rows(w: WindowSpec, points: int, centering: str = "center") -> WindowSpec:
    """Soft window of ``points`` rows; a centred one takes points // 2 on each side."""
    before, after = {"left": (points - 1, 0), "right": (0, points - 1), "center": (points // 2, points // 2)}[centering]
    return w.rowsBetween(-before, after)


def span(w: WindowSpec, seconds: int, centering: str = "center") -> WindowSpec:
    us = seconds * 1_000_000
    return w.rangeBetween(*{"left": (-us, 0), "right": (0, us), "center": (-us // 2, us // 2)}[centering])


def minimum(x: Column, low: float, soft: bool = False, reset: float | None = None) -> Column:
    return F.when(x < low, F.lit(low if reset is None else reset) if soft else None).otherwise(x)


def maximum(x: Column, high: float, soft: bool = False, reset: float | None = None) -> Column:
    return F.when(x > high, F.lit(high if reset is None else reset) if soft else None).otherwise(x)


def min_max(x: Column, low: float, high: float, soft: bool = False, low_reset: float | None = None, high_reset: float | None = None) -> Column:
    a, b = (low if low_reset is None else low_reset, high if high_reset is None else high_reset) if soft else (None, None)
    return F.when(x < low, F.lit(a)).when(x > high, F.lit(b)).otherwise(x)


def conditional(x: Column, filtered: Column, condition: Column) -> Column:
    """``filtered`` where another parameter's condition holds; unknown counts as not."""
    return F.when(F.coalesce(condition, F.lit(False)), filtered).otherwise(x)


def std_dev(x: Column, w: WindowSpec, k: float = 2.0) -> Column:
    far = F.abs(x - F.avg(x).over(w)) > k * F.stddev_samp(x).over(w)
    return F.when((F.count(x).over(w) >= 2) & far, None).otherwise(x)


def mad(x: Column, w: WindowSpec, k: float = 3.0, min_sigma: float = 0.0) -> Column:
    """Null beyond k robust deviations from the window's median."""
    values = F.sort_array(F.collect_list(x).over(w))

    def median(a: Column) -> Column:
        n = F.size(a)
        return F.when(n > 0, (F.get(a, ((n - 1) / 2).cast("int")) + F.get(a, (n / 2).cast("int"))) / 2)

    middle = median(values)
    sigma = 1.4826 * median(F.sort_array(F.transform(values, lambda v: F.abs(v - middle))))
    return F.when(F.abs(x - middle) > k * F.greatest(sigma, F.lit(min_sigma)), None).otherwise(x)


def no_change(x: Column, w: WindowSpec, max_variance: float = 0.0) -> Column:
    return F.when(F.var_samp(x).over(w) <= max_variance, None).otherwise(x)


def time_consistency(x: Column, series: WindowSpec, w: WindowSpec) -> Column:
    before, after = F.lag(x).over(series), F.lead(x).over(series)
    return F.when(F.abs(x - before) + F.abs(x - after) > 4 * F.stddev_samp(x).over(w), None).otherwise(x)


def backward(*station: str, time: str = "t_us") -> WindowSpec:
    """A station's series from its end to its start."""
    return Window.partitionBy(*station).orderBy(F.desc(time))


def rate_right(x: Column, time: Column, latest_first: WindowSpec, most: float) -> Column:
    """Null if the rate per second to the next value leaves [-most, most]; ``latest_first`` is the series in falling time, so its frame only grows."""
    later = latest_first.rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(x.isNotNull(), F.struct(x.alias("x"), time.alias("t"))), ignorenulls=True).over(later)
    return F.when(F.abs((nxt["x"] - x) / ((nxt["t"] - time) / 1e6)) > most, None).otherwise(x)


def rate_left(df: DataFrame, station: str, time: str, value: str, most: float) -> DataFrame:
    """Null if the rate per second from the last accepted value leaves [-most, most]; the first value is never tested."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        last_t = last_x = None
        out = []
        for t, x in zip(pdf[time].tolist(), pdf[value].tolist(), strict=True):
            if x == x and last_t is not None and abs((x - last_x) / max((t - last_t) / 1e6, 1e-7)) > most:
                out.append(None)
                continue
            out.append(x)
            if x == x:
                last_t, last_x = t, x
        return pdf.assign(**{value: pd.Series(out, index=pdf.index, dtype=float)})

    return df.groupBy(station).applyInPandas(f, df.schema)


def deaccumulate(x: Column, series: WindowSpec) -> Column:
    before = F.last(x, ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(x >= before, x - before).when(x < before, x)


def aggregate(x: Column, w: WindowSpec, kind: str = "mean") -> Column:
    """min, max, mean or median of the window's values."""
    if kind == "median":
        return F.percentile(x, F.lit(0.5)).over(w)
    return {"min": F.min, "max": F.max, "mean": F.avg}[kind](x).over(w)


def wma(x: Column, series: WindowSpec, reach: int) -> Column:
    """Linear weights reach + 1 - distance over the row and the means of its symmetric pairs, as far as there are values. Fills nulls too."""
    total, weights = F.lit(0.0), F.lit(0)
    for d in range(reach + 1):
        a, b = F.lag(x, d).over(series), F.lead(x, d).over(series)
        pair = F.coalesce((a + b) / 2, a, b) if d else x
        total = total + F.coalesce(pair * (reach + 1 - d), F.lit(0.0))
        weights = weights + F.when(pair.isNotNull(), reach + 1 - d).otherwise(0)
    return total / F.nullif(weights, F.lit(0))


def unheated_raingauge(psum: Column, rh: Column, ta: Column, tss: Column, rh_min: float = 0.5, dt_max: float = 3.0, soft: bool = True) -> Column:
    dry = (rh < rh_min) | (ta - tss > dt_max)
    out = F.when((psum > 0) & F.coalesce(dry, F.lit(False)), 0.0)
    return (out if soft else out.when((psum > 0) & dry.isNull(), None)).otherwise(psum)


def undercatch(psum: Column, ta: Column, vw: Column, gauge: str, t_snow: float = -2.0, t_rain: float = 2.0) -> Column:
    """Catch correction for snow and mixed precipitation of NIPHER, TRETYAKOV, US8SH, US8UNSH or HELLMANN gauges."""
    from stratus.functions.atmosphere import wind_log_profile

    t = F.greatest(ta - 273.15, F.lit(-15.0))
    v = F.least(wind_log_profile(vw, 10.0, 2.0), F.lit(7.0))
    #: Catch ratios in percent for (snow, mixed).
    snow, mixed = {
        "NIPHER": (100 - 0.44 * v * v - 1.98 * v, 97.29 - 3.18 * v - 0.09 * t),
        "TRETYAKOV": (103.11 - 8.67 * v + 0.30 * t, 96.99 - 4.46 * v + 1.10 * t),
        "US8SH": (F.exp(4.61 - 0.04 * F.pow(v, 1.75)), 101.04 - 5.62 * v),
        "US8UNSH": (F.exp(4.61 - 0.16 * F.pow(v, 1.28)), 100.77 - 8.34 * v),
        "HELLMANN": (100 + 1.13 * v * v - 19.45 * v, 96.63 + 0.41 * v * v - 9.84 * v + 5.95 * t),
    }[gauge]
    ratio = F.when(t <= t_snow, snow).when(t >= t_rain, 100.0).otherwise(mixed)
    return F.when((psum == 0) | ta.isNull() | vw.isNull(), psum).otherwise(psum * 100 / ratio)


def shift_time(time: Column, seconds: float) -> Column:
    return time + F.lit(int(seconds * 1_000_000))


def kalman(df: DataFrame, station: str, time: str, value: str, process: float, observation: float) -> DataFrame:
    """Scalar random-walk Kalman filter; nulls are predicted over and stay null."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)

        def states() -> Iterator[float | None]:
            x = p = None
            for z in pdf[value].tolist():
                if z != z:
                    yield None
                    continue
                if x is None:
                    x, p = z, observation
                else:
                    p += process
                    gain = p / (p + observation)
                    x, p = x + gain * (z - x), (1 - gain) * p
                yield x

        return pdf.assign(**{value: pd.Series(list(states()), index=pdf.index, dtype=float)})

    return df.groupBy(station).applyInPandas(f, df.schema)
