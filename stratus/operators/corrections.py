"""Corrections and smoothers of a station's series beyond plain bounds; null stays null unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stratus.functions.atmosphere import T_FREEZE, saturation_pressure, saturation_pressure_water, wind_log_profile


def by_period(time: Column, period: str, values: list[float]) -> Column:
    """The correction of a row's "hour", "month" or "day" of the year; ``time`` is in microseconds, UTC."""
    at = F.timestamp_micros(time)
    place = {"hour": lambda: F.hour(at) + 1, "month": lambda: F.month(at), "day": lambda: F.dayofyear(at)}[period]()
    return F.get(F.array(*(F.lit(float(v)) for v in values)), place - 1)


def exp_smoothing(x: Column, series: WindowSpec, reach: int, alpha: float) -> Column:
    """Folds outward from the row, which itself is left out; farther pairs weigh ``alpha``. Fills nulls too."""
    pairs = []
    for d in range(1, reach + 1):
        a, b = F.lag(x, d).over(series), F.lead(x, d).over(series)
        pairs.append(F.coalesce((a + b) / 2, a, b))
    return F.aggregate(F.array(*pairs), F.lit(None).cast("double"), lambda s, v: F.when(v.isNull(), s).when(s.isNull(), v).otherwise(alpha * v + (1 - alpha) * s))


def tukey(df: DataFrame, station: str, order: list[str], value: str, k: float, w: WindowSpec, soft: bool = True) -> DataFrame:
    """Null where a row is over k standard deviations from the 53H smoother, which needs four rows on each side."""
    s = Window.partitionBy(station).orderBy(*order)
    half = F.lit(0.5)
    five = df.withColumn("_m5", F.percentile(value, half).over(s.rowsBetween(-2, 2))).withColumn("_sd", F.stddev_samp(value).over(w))
    three = five.withColumn("_m3", F.percentile("_m5", half).over(s.rowsBetween(-1, 1)))
    sides = [(F.lag("_m3").over(s), 1), (F.col("_m3"), 2), (F.lead("_m3").over(s), 1)]
    total = sum((F.coalesce(m * n, F.lit(0.0)) for m, n in sides), F.lit(0.0))
    count = sum((F.when(m.isNotNull(), n).otherwise(0) for m, n in sides), F.lit(0))
    inside = F.lag(F.lit(1), 4).over(s).isNotNull() & F.lead(F.lit(1), 4).over(s).isNotNull()
    smooth = F.when(inside & (count > 0), total / F.nullif(count, F.lit(0)))
    far = F.abs(F.col(value) - smooth) > k * F.col("_sd")
    out = F.when(far, None) if soft else F.when(far | smooth.isNull() | F.col("_sd").isNull(), None)
    return three.withColumn(value, out.otherwise(F.col(value))).drop("_m5", "_m3", "_sd")


#: Gauge → (°C above which each coefficient holds, coefficient), then the coefficient below all of them.
HAMON = {
    "unsh": ((1.67, 0.0146), (0.0, 0.0294), (-5.0, 0.0527), 0.0889),
    "sh": ((1.67, 0.0060), (0.0, 0.0121), (-5.0, 0.0217), 0.0366),
    "hellmannsh": ((1.2, 0.0), (0.0, 0.0294), (-5.0, 0.0527), 0.0889),
}


def undercatch_hamon(psum: Column, ta: Column, vw: Column, gauge: str) -> Column:
    """Wind correction exp(k v) of a gauge "unsh", "sh" or "hellmannsh", k by air temperature, wind at 2 m."""
    *steps, below = HAMON[gauge]
    (limit, k), *rest = steps
    factor = F.when(ta - T_FREEZE > limit, k)
    for limit, k in rest:
        factor = factor.when(ta - T_FREEZE > limit, k)
    caught = psum * F.exp(factor.otherwise(below) * wind_log_profile(vw, 10.0, 2.0))
    return F.when(ta.isNull() | vw.isNull() | (psum == 0), psum).otherwise(caught)


def humidity_over_ice(rh: Column, ta: Column) -> Column:
    return F.when(ta.isNull(), rh).otherwise(rh * saturation_pressure_water(ta) / saturation_pressure(ta))


def calm_temperature(ta: Column, vw: Column, least_wind: float) -> Column:
    """Null below a wind speed that ventilates the sensor; unknown wind keeps the value."""
    return F.when(vw < least_wind, None).otherwise(ta)


def radiation_error(ta: Column, vw: Column, radiation: Column, scheme: str) -> Column:
    """Unventilated temperature less its radiative error: NAKAMURA takes incoming, HUWALD reflected radiation."""
    x = radiation / (1.2 * 1004.0 * ta * F.greatest(vw, F.lit(0.1)))
    error, known = {"NAKAMURA": (0.13 + 373.40 * x, x >= 1e-4), "HUWALD": (3.1 * F.sqrt(1e3 * x), 1e3 * x >= 0.05)}[scheme]
    return F.when(vw.isNotNull() & known, ta - error).otherwise(ta)


def clean_up(df: DataFrame, keys: list[str], params: list[str]) -> DataFrame:
    """Time filter: rows of one station and time become one, each parameter the mean of its values."""
    return df.groupBy(*keys).agg(*(F.avg(p).alias(p) for p in params))


#: Humidity and temperature difference to the surface that make precipitation likely.
WET_RH, CLOUDY_DT = 0.7, 3.0


def distribute_sums(df: DataFrame, station: str, time: str, psum: str, rh: str, ta: str, tss: str, period: int) -> DataFrame:
    """Sums that stand at the end of a measuring ``period`` (seconds) dealt over the rows before them.

    A sum goes to those rows of its period where precipitation is likeliest (humid, cloudy), in proportion to their time. Periods
    follow each other from the last sum or the first row on; one without a sum ends at its last row, and its rows get 0, as do
    the rows behind the last sum. A row that the next one follows only after more than a period, and that a period begins with, gets 0.
    The first row keeps its value else. Times of a series are distinct; the rows from one sum to the next meet in a task.
    """
    us, series = period * 1_000_000, Window.partitionBy(station).orderBy(time)
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    t, x = F.col(time), F.col(psum)
    rows = df.withColumns({
        "part_": F.count(x).over(before), "since_": F.coalesce(F.max(F.when(x.isNotNull(), t)).over(before), F.min(t).over(series.rowsBetween(Window.unboundedPreceding, 0))),
        "dur_": t - F.lag(time).over(series), "next_": F.lead(time).over(series),
    })
    part = Window.partitionBy(station, "part_")
    rows = rows.withColumns({"times_": F.sort_array(F.collect_list(F.when(F.col("dur_").isNotNull(), t)).over(part)), "from_": F.min("since_").over(part)})

    def step(at, now):
        """Begin of the period that a row falls into, and the row."""
        later = F.when(now <= at["seen"] + us, at["seen"]).otherwise(now)
        return F.struct(F.when(now <= at["begin"] + us, at["begin"]).otherwise(later).alias("begin"), now.alias("seen"))

    begun = F.aggregate("times_", F.struct(F.col("from_").alias("begin"), F.col("from_").alias("seen")), step)
    rows = rows.withColumns({"begin_": begun["begin"], "sum_": F.max(psum).over(part), "end_": F.max(F.when(x.isNotNull(), t)).over(part)})
    humid = F.coalesce((F.col(rh) >= WET_RH).cast("int"), F.lit(0))
    cloudy = F.coalesce((F.col(ta) - F.col(tss) <= CLOUDY_DT).cast("int"), F.lit(0))
    inside = (t > F.col("begin_")) & F.col("dur_").isNotNull()
    rows = rows.withColumn("score_", F.when(inside, humid + cloudy))
    rows = rows.withColumn("best_", F.max("score_").over(part))
    rows = rows.withColumn("time_", F.sum(F.when(F.col("score_") == F.col("best_"), F.col("dur_"))).over(part))
    share = F.when(F.col("score_") == F.col("best_"), F.col("sum_") * F.col("dur_") / F.col("time_")).otherwise(0.0)
    stands = F.col("end_").isNotNull() & (F.col("begin_") == F.col("end_")) & (t == F.col("end_"))
    out = F.when(F.col("next_") - t > us, 0.0).when(F.col("dur_").isNull() | stands, x).when(F.col("end_").isNull(), 0.0).otherwise(share)
    return rows.withColumn(psum, out).select(*df.columns)


def quantile_map(df: DataFrame, station: str, value: str, quantiles: list[float], corrections: list[float], multiply: bool = True) -> DataFrame:
    """``value`` corrected by the quantile of its station's values that it falls into; missing values count as 0 in the quantiles.

    A value takes the correction of the first threshold that it does not exceed if that is below 0.5, else of the one before; without
    one it takes 1.
    """
    x = F.col(value)
    limits = df.groupBy(station).agg(F.percentile(F.coalesce(x, F.lit(0.0)), F.array(*map(F.lit, quantiles))).alias("limits_"))
    place = F.lit(None).cast("double")
    for k in range(len(quantiles) - 1, -1, -1):
        limit = F.col("limits_")[k]
        place = F.when(x <= limit, F.when(limit < 0.5, corrections[k]).otherwise(corrections[k - 1] if k else None)).otherwise(place)
    factor = F.coalesce(place, F.lit(1.0))
    return df.join(limits, station).withColumn(value, x * factor if multiply else x + factor).select(*df.columns)
