"""One query for each operator over the given tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.functions import atmosphere as air
from stratus.functions import radiation as ra
from stratus.functions import sun
from stratus.operators import corrections as co
from stratus.operators import despiking as ds
from stratus.operators import filters as fl
from stratus.operators import formulas as fm
from stratus.operators import frames as fr
from stratus.operators import generators as ge
from stratus.operators import horizon as ho
from stratus.operators import kriging as kg
from stratus.operators import recursions as rc
from stratus.operators import regrid as rg
from stratus.operators import resampling as rs
from stratus.operators import series as se
from stratus.operators import shortwave as sw
from stratus.operators import spatial as sp
from stratus.operators import terrain as te
from stratus.sources.tables import CELLS, ELEVATIONS, HOUR, OBS, STATIONS, WEATHER, cells, elevations, observations, stations, weather

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
R = lambda c, name: F.round(c, 4).alias(name)
R8 = lambda c, name: F.round(c, 8).alias(name)
W = "(PARTITION BY station ORDER BY t_us, event_id)"


def query(sql: str | None = None):
    def f(g):
        QUERIES[g.__name__] = g
        if sql:
            ORACLES[g.__name__] = sql
        return g

    return f


def _series():
    return fl.over("station", time="t_us").orderBy("t_us", "event_id")


AROUND = f"""
WITH {OBS}, g AS (SELECT station, unnest(generate_series(CAST(ceil(min(t_us)/{HOUR}.0) AS BIGINT), CAST(floor(max(t_us)/{HOUR}.0) AS BIGINT)))*{HOUR} AS t_us FROM o GROUP BY station),
n AS (SELECT g.station, g.t_us, a.t_us AS t1, a.x AS x1, b.t_us AS t2, b.x AS x2 FROM g
 ASOF LEFT JOIN (SELECT * FROM o WHERE x IS NOT NULL) a ON a.station = g.station AND g.t_us >= a.t_us
 ASOF LEFT JOIN (SELECT * FROM o WHERE x IS NOT NULL) b ON b.station = g.station AND g.t_us <= b.t_us),
p AS (SELECT station, t_us, CASE WHEN t1 >= t_us - {{w}} THEN t1 END AS t1, CASE WHEN t1 >= t_us - {{w}} THEN x1 END AS x1, CASE WHEN t2 <= t_us + {{w}} THEN t2 END AS t2, CASE WHEN t2 <= t_us + {{w}} THEN x2 END AS x2 FROM n)
"""
DAY = 24 * HOUR
_TYPES = OBS.replace("user_id AS station", "event_type AS station").replace("obs AS", "obs0 AS")
_NEAR = AROUND.replace(OBS, _TYPES + ", o AS (SELECT station, t_us, min(x) AS x FROM obs0 GROUP BY station, t_us)")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense series of the event types, one row for each time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.groupBy(F.col("event_type").alias("station"), t.alias("t_us")).agg(F.min(F.when(F.col("event_id") % 7 != 0, F.col("value"))).alias("x"))


LINEAR = "CASE WHEN t1 = t2 THEN x1 WHEN t2 - t1 <= {w} THEN x1 + (x2 - x1) * (t_us - t1) / (t2 - t1)::DOUBLE END"


@query(_NEAR.format(w=DAY).replace("min(x) AS x", "min(CASE WHEN x < 10 THEN 10 WHEN x > 90 THEN 90 ELSE x END) AS x") + f"SELECT station, t_us, round(coalesce({LINEAR.format(w=DAY)}, 50.0), 4) AS x FROM p")
def flagship_hourly(spark, d):
    """MIN_MAX (soft), linear resampling to hours, constant generator."""
    obs = _dense(spark, d).withColumn("x", fl.min_max(F.col("x"), 10.0, 90.0, soft=True))
    out = se.resample_linear(obs, se.grid_of(obs, "station", "t_us", HOUR), "station", "t_us", "x", DAY)
    return out.select("station", "t_us", R(F.coalesce("x", F.lit(50.0)), "x"))


@query(_NEAR.format(w=DAY) + "SELECT station, t_us, round(CASE WHEN t1 IS NULL OR t2 IS NULL THEN NULL WHEN t1 = t2 THEN x1 WHEN abs((t_us - t1) - (t2 - t_us)) <= 6000000 THEN (x1 + x2) / 2 WHEN t_us - t1 < t2 - t_us THEN x1 ELSE x2 END, 4) AS x FROM p")
def resample_nearest(spark, d):
    obs = _dense(spark, d)
    out = se.resample_nearest(obs, se.grid_of(obs, "station", "t_us", HOUR), "station", "t_us", "x", DAY)
    return out.select("station", "t_us", R(F.col("x"), "x"))


@query(f"WITH {OBS} SELECT event_id, CASE WHEN x >= 20 THEN x END AS min_hard, CASE WHEN x < 20 THEN 20 ELSE x END AS min_soft, CASE WHEN x <= 80 THEN x END AS max_hard, CASE WHEN x > 80 THEN 75 ELSE x END AS max_reset, CASE WHEN x BETWEEN 20 AND 80 THEN x END AS minmax_hard FROM obs")
def filter_min_max(spark, d):
    x = F.col("x")
    return observations(spark, d).select("event_id", fl.minimum(x, 20.0).alias("min_hard"), fl.minimum(x, 20.0, soft=True).alias("min_soft"), fl.maximum(x, 80.0).alias("max_hard"), fl.maximum(x, 80.0, soft=True, reset=75.0).alias("max_reset"), fl.min_max(x, 20.0, 80.0).alias("minmax_hard"))


@query(f"WITH {WEATHER} SELECT event_id, round(CASE WHEN TA < 273.15 AND PSUM > 2 THEN NULL ELSE PSUM END, 4) AS psum FROM w")
def filter_min_max_conditional(spark, d):
    p = F.col("PSUM")
    return weather(spark, d).select("event_id", R(fl.conditional(p, fl.maximum(p, 2.0), F.col("TA") < 273.15), "psum"))


@query(f"WITH {OBS}, s AS (SELECT event_id, x, avg(x) OVER f AS m, stddev_samp(x) OVER f AS sd, count(x) OVER f AS n FROM obs WINDOW f AS (PARTITION BY station ORDER BY t_us, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) SELECT event_id, CASE WHEN n >= 2 AND abs(x - m) > 2 * sd THEN NULL ELSE x END AS x FROM s")
def filter_std_dev(spark, d):
    return observations(spark, d).select("event_id", fl.std_dev(F.col("x"), fl.rows(_series(), 9)).alias("x"))


@query(f"""WITH {OBS}, s AS (SELECT *, list(x) FILTER (x IS NOT NULL) OVER (PARTITION BY station ORDER BY t_us, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS l FROM obs), m AS (SELECT event_id, x, l, list_median(l) AS md FROM s)
SELECT event_id, CASE WHEN abs(x - md) > 3 * 1.4826 * list_median(list_transform(l, lambda v: abs(v - md))) THEN NULL ELSE x END AS x FROM m""")
def filter_mad(spark, d):
    return observations(spark, d).select("event_id", fl.mad(F.col("x"), fl.rows(_series(), 9)).alias("x"))


@query(f"WITH {OBS} SELECT event_id, CASE WHEN var_samp(x) OVER (PARTITION BY station ORDER BY t_us, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) <= 100 THEN NULL ELSE x END AS x FROM obs")
def filter_no_change(spark, d):
    return observations(spark, d).select("event_id", fl.no_change(F.col("x"), fl.rows(_series(), 3), 100.0).alias("x"))


@query(f"WITH {OBS}, s AS (SELECT event_id, x, lag(x) OVER {W} AS a, lead(x) OVER {W} AS b, stddev_samp(x) OVER (PARTITION BY station ORDER BY t_us, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS sd FROM obs) SELECT event_id, CASE WHEN abs(x - a) + abs(x - b) > 4 * sd THEN NULL ELSE x END AS x FROM s")
def filter_time_consistency(spark, d):
    return observations(spark, d).select("event_id", fl.time_consistency(F.col("x"), _series(), fl.rows(_series(), 9)).alias("x"))


@query(f"WITH {OBS}, v AS (SELECT event_id, lead(x) OVER {W} AS nx, lead(t_us) OVER {W} AS nt, x, t_us FROM obs WHERE x IS NOT NULL) SELECT o.event_id, CASE WHEN abs((v.nx - v.x) / ((v.nt - v.t_us) / 1e6)) > 0.001 THEN NULL ELSE o.x END AS x FROM obs o LEFT JOIN v USING (event_id)")
def filter_rate_right(spark, d):
    return observations(spark, d).select("event_id", fl.rate_right(F.col("x"), F.col("t_us"), fl.backward("station").orderBy(F.desc("t_us"), F.desc("event_id")), 0.001).alias("x"))


_STEP = f"WITH RECURSIVE {OBS}, i AS (SELECT *, row_number() OVER {W} AS i FROM obs)"


@query(_STEP + """, r AS (SELECT station, i, event_id, x, x AS lx, CASE WHEN x IS NOT NULL THEN t_us END AS lt FROM i WHERE i = 1 UNION ALL
 SELECT station, i, event_id, CASE WHEN bad THEN NULL ELSE x END, CASE WHEN x IS NULL OR bad THEN lx ELSE x END, CASE WHEN x IS NULL OR bad THEN lt ELSE t_us END
 FROM (SELECT d.*, r.lx, r.lt, coalesce(abs((d.x - r.lx) / greatest((d.t_us - r.lt) / 1e6, 1e-7)) > 0.001, false) AS bad FROM r JOIN i d ON d.station = r.station AND d.i = r.i + 1))
SELECT event_id, x FROM r""")
def filter_rate_left(spark, d):
    return fl.rate_left(observations(spark, d), "station", "t_us", "x", 0.001).select("event_id", "x")


@query(_STEP + """, r AS (SELECT station, i, event_id, x AS y, x AS s, CASE WHEN x IS NOT NULL THEN 25.0::DOUBLE END AS p FROM i WHERE i = 1 UNION ALL
 SELECT station, i, event_id, CASE WHEN x IS NULL THEN NULL WHEN s IS NULL THEN x ELSE s + q / (q + 25) * (x - s) END,
  CASE WHEN x IS NULL THEN s WHEN s IS NULL THEN x ELSE s + q / (q + 25) * (x - s) END, CASE WHEN x IS NULL THEN p WHEN s IS NULL THEN 25 ELSE (1 - q / (q + 25)) * q END
 FROM (SELECT d.*, r.s, r.p, r.p + 1 AS q FROM r JOIN i d ON d.station = r.station AND d.i = r.i + 1))
SELECT event_id, round(y, 4) AS x FROM r""")
def filter_kalman(spark, d):
    return fl.kalman(observations(spark, d), "station", "t_us", "x", 1.0, 25.0).select("event_id", R(F.col("x"), "x"))


@query(f"WITH {OBS} SELECT event_id, round(avg(x) OVER f, 8) AS mean, min(x) OVER f AS lo, max(x) OVER f AS hi, round(median(x) OVER f, 8) AS mid FROM obs WINDOW f AS (PARTITION BY station ORDER BY t_us RANGE BETWEEN {7 * DAY} PRECEDING AND CURRENT ROW)")
def filter_aggregate(spark, d):
    w = fl.span(fl.over("station"), 7 * 86400, "left")
    x = F.col("x")
    return observations(spark, d).select("event_id", R8(fl.aggregate(x, w), "mean"), fl.aggregate(x, w, "min").alias("lo"), fl.aggregate(x, w, "max").alias("hi"), R8(fl.aggregate(x, w, "median"), "mid"))


@query(f"WITH {OBS}, v AS (SELECT event_id, x, lag(x) OVER {W} AS b FROM obs WHERE x IS NOT NULL) SELECT o.event_id, round(CASE WHEN v.x >= v.b THEN v.x - v.b WHEN v.x < v.b THEN v.x END, 4) AS x FROM obs o LEFT JOIN v USING (event_id)")
def filter_deaccumulate(spark, d):
    return observations(spark, d).select("event_id", R(fl.deaccumulate(F.col("x"), _series()), "x"))


_PAIRS = """s AS (SELECT event_id, x, lag(x, 1) OVER {W} AS a, lag(x, 2) OVER {W} AS aa, lead(x, 1) OVER {W} AS b, lead(x, 2) OVER {W} AS bb FROM obs),
pairs AS (SELECT event_id, x, coalesce((a+b)/2, a, b) AS p1, coalesce((aa+bb)/2, aa, bb) AS p2 FROM s)""".replace("{W}", W)


@query(f"""WITH {OBS}, {_PAIRS}
SELECT event_id, round((coalesce(3*x, 0) + coalesce(2*p1, 0) + coalesce(p2, 0)) / nullif(3*(x IS NOT NULL)::INT + 2*(p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT, 0), 8) AS x FROM pairs""")
def filter_wma_smoothing(spark, d):
    return observations(spark, d).select("event_id", R8(fl.wma(F.col("x"), _series(), 2), "x"))


@query(f"WITH {WEATHER} SELECT event_id, round(CASE WHEN PSUM > 0 AND (RH < 0.5 OR TA - TSS > 3) THEN 0 ELSE PSUM END, 4) AS psum FROM w")
def filter_unheated_raingauge(spark, d):
    return weather(spark, d).select("event_id", R(fl.unheated_raingauge(F.col("PSUM"), F.col("RH"), F.col("TA"), F.col("TSS")), "psum"))


_CATCH = "CASE WHEN t <= -2 THEN {snow} WHEN t >= 2 THEN 100 ELSE {mixed} END"


@query(f"""WITH {WEATHER}, c AS (SELECT event_id, PSUM, greatest(TA - 273.15, -15) AS t, least(VW * ln(2/0.03)/ln(10/0.03), 7) AS v FROM w)
SELECT event_id, round(PSUM * 100 / {_CATCH.format(snow='(100 - 0.44*v*v - 1.98*v)', mixed='(97.29 - 3.18*v - 0.09*t)')}, 4) AS nipher, round(PSUM * 100 / {_CATCH.format(snow='(103.11 - 8.67*v + 0.3*t)', mixed='(96.99 - 4.46*v + 1.1*t)')}, 4) AS tretyakov,
 round(PSUM * 100 / {_CATCH.format(snow='exp(4.61 - 0.04*pow(v, 1.75))', mixed='(101.04 - 5.62*v)')}, 4) AS us8sh, round(PSUM * 100 / {_CATCH.format(snow='(100 + 1.13*v*v - 19.45*v)', mixed='(96.63 + 0.41*v*v - 9.84*v + 5.95*t)')}, 4) AS hellmann FROM c""")
def filter_undercatch_wmo(spark, d):
    got = lambda gauge: R(fl.undercatch(F.col("PSUM"), F.col("TA"), F.col("VW"), gauge), gauge.lower())
    return weather(spark, d).select("event_id", *(got(g) for g in ("NIPHER", "TRETYAKOV", "US8SH", "HELLMANN")))


@query(f"WITH {WEATHER} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TSS ELSE TA END AS TA, CASE WHEN event_id % 2 = 0 THEN TA ELSE TSS END AS TSS, NULL::DOUBLE AS VW, CASE WHEN event_id % 3 = 0 THEN NULL ELSE RH END AS RH, CLD AS COPY, VW AS WIND FROM w")
def edit_columns(spark, d):
    """SWAP, EXCLUDE, COPY and RENAME."""
    df = se.swap(weather(spark, d).withColumn("WIND", F.lit(None).cast("double")), "TA", "TSS", F.col("event_id") % 2 == 0)
    df = se.rename(se.exclude(df, ["RH"], F.col("event_id") % 3 == 0), ["VW"], "WIND")
    return df.select("event_id", "TA", "TSS", "VW", "RH", F.col("CLD").alias("COPY"), "WIND")


_HALVES = f"""{OBS}, a AS (SELECT station, t_us // {DAY} AS day, min(x) AS x FROM obs WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT station, t_us // {DAY} AS day, max(x) AS x FROM obs WHERE event_id % 2 = 1 GROUP BY ALL),
e AS (SELECT station, min(day) AS lo, max(day) AS hi FROM a GROUP BY station)"""
_JOINED = "SELECT station, day, {x} AS x FROM (SELECT coalesce(a.station, b.station) AS station, coalesce(a.day, b.day) AS day, a.x AS ax, b.x AS bx, a.station IS NOT NULL AS ina FROM a {kind} JOIN b ON a.station = b.station AND a.day = b.day) j LEFT JOIN e USING (station) WHERE {cond}"


def _halves(spark, d):
    obs = observations(spark, d).withColumn("day", F.floor(F.col("t_us") / DAY).cast("long"))
    return (obs.where("event_id % 2 = 0").groupBy("station", "day").agg(F.min("x").alias("x")), obs.where("event_id % 2 = 1").groupBy("station", "day").agg(F.max("x").alias("x")))


_MERGES = {
    "strict_first": ("STRICT_MERGE", "PRIORITY_FIRST", "coalesce(ax, bx)", "LEFT", "true"),
    "full_last": ("FULL_MERGE", "PRIORITY_LAST", "coalesce(bx, ax)", "FULL", "true"),
    "expand_average": ("EXPAND_MERGE", "AVERAGE", "coalesce((ax + bx) / 2, ax, bx)", "FULL", "(ina OR lo IS NULL OR NOT day BETWEEN lo AND hi)"),
    "window_first": ("WINDOW_MERGE", "PRIORITY_FIRST", "coalesce(ax, bx)", "FULL", "day BETWEEN lo AND hi"),
}
for _name, (_strategy, _conflicts, _x, _kind, _cond) in _MERGES.items():
    QUERIES[f"merge_{_name}"] = lambda spark, d, s=_strategy, c=_conflicts: se.merge(*_halves(spark, d), ["station"], "day", ["x"], s, c)
    ORACLES[f"merge_{_name}"] = f"WITH {_HALVES} " + _JOINED.format(x=_x, kind=_kind, cond=_cond)


@query(f"WITH {OBS} SELECT station, t_us // {DAY} AS day, arg_min(x, event_id) FILTER (x IS NOT NULL) AS x FROM obs GROUP BY ALL")
def edit_automerge(spark, d):
    obs = observations(spark, d).withColumn("day", F.floor(F.col("t_us") / DAY).cast("long"))
    return se.automerge(obs, ["station", "day"], "event_id", ["x"])


@query(f"""WITH {_HALVES}, fit AS (SELECT a.station, regr_slope(a.x, b.x) AS s, regr_intercept(a.x, b.x) AS i FROM a JOIN b ON a.station = b.station AND a.day = b.day GROUP BY a.station)
SELECT station, day, round(x, 4) AS x FROM a UNION ALL SELECT b.station, b.day, round(s * b.x + i, 4) FROM b JOIN fit USING (station) WHERE b.station IN (SELECT station FROM a LEFT JOIN b b2 USING (station, day) GROUP BY station HAVING count(*) > count(b2.day)) AND s IS NOT NULL AND NOT isnan(s) AND NOT EXISTS (SELECT 1 FROM a WHERE a.station = b.station AND a.day = b.day)""")
def edit_regression_fill(spark, d):
    a, b = _halves(spark, d)
    return se.regression_fill(a, b, ["station"], "day", "x").select("station", "day", R(F.col("x"), "x"))


@query(f"WITH {OBS} SELECT event_id, coalesce(round(CASE WHEN x > 5 THEN sqrt(x) + 2 * x ELSE x * x - 1 END, 6), -999.0) AS x FROM obs")
def filter_maths(spark, d):
    two = fm.maths(observations(spark, d), "x", "sqrt(meteo(X)) + 2 * meteo(x)", "meteo(X)^2 - 1", [fm.Condition("meteo(X)", "GT", "5")], skip_nodata=True)
    return two.select("event_id", F.coalesce(F.round("x", 6), F.lit(-999.0)).alias("x"))


@query(f"WITH {WEATHER} SELECT event_id, CASE WHEN CLD < 0.5 THEN round(TA - 2.5, 6) END AS TD, CASE WHEN CLD < 0.5 THEN ALT + 10 ELSE ALT END AS ALT, CASE WHEN CLD < 0.5 THEN TA END AS TA FROM w")
def edit_create_metadata_keep(spark, d):
    wet = F.col("CLD") < 0.5
    made = se.create(weather(spark, d), "TD", F.round(F.col("TA") - 2.5, 6), wet)
    moved = se.metadata(made, {"ALT": F.col("ALT") + 10}, wet)
    return se.keep(moved, ["TD"], ["TA", "TD"], ~wet).select("event_id", "TD", "ALT", "TA")


@query(f"""WITH {_HALVES}, c AS (SELECT station, day + 1 AS day, x + 100 AS x FROM a)
SELECT station, day, coalesce(a.x, b.x, c.x) AS x FROM a FULL JOIN b USING (station, day) FULL JOIN c USING (station, day)""")
def merge_list(spark, d):
    a, b = _halves(spark, d)
    later = a.select("station", (F.col("day") + 1).alias("day"), (F.col("x") + 100).alias("x"))
    return se.merge_all([a, b, later], ["station"], "day", ["x"], "FULL_MERGE")


_ES = "611.73*exp(CASE WHEN TA < 273.16 THEN 21.88*(TA-273.16)/(TA-7.66) ELSE 17.27*(TA-273.16)/(TA-35.86) END)"
_SB = "5.670373e-8*pow(TA,4)"


@query(f"""WITH {WEATHER} SELECT event_id, round(101325.0*pow(1-0.0065*6356766.0*ALT/(288.15*(6356766.0+ALT)), 9.80665/(0.0065*287.058)), 4) AS p, round({_ES}, 4) AS es,
 round(9.780356*(1+0.0052885*pow(sin(radians(LAT)),2)-0.0000059*pow(sin(2*radians(LAT)),2))-0.003086*ALT*1e-3, 4) AS g, round(VW*ln(2/0.03)/ln(10/0.03), 4) AS v2 FROM w""")
def law_pressure_humidity(spark, d):
    c = F.col
    return weather(spark, d).select("event_id", R(air.std_pressure(c("ALT")), "p"), R(air.saturation_pressure(c("TA")), "es"), R(air.gravity(c("ALT"), c("LAT")), "g"), R(air.wind_log_profile(c("VW"), 10.0, 2.0), "v2"))


_DRY = "101325.0*pow(1-0.0065*6356766.0*ALT/(288.15*(6356766.0+ALT)), 9.80665/(0.0065*287.058))/(287.058*TA)"
_RATIO = lambda b, k: f"exp({b}*(TD-273.15)/({k}+TD-273.15))/exp({b}*(TA-273.15)/({k}+TA-273.15))"
_ICE, _WATER = "(1/(pow(TA-257.15,2)+1e-6))", "(1/(pow(TA-273.15,2)+1e-6))"


@query(f"""WITH {WEATHER}, s AS (SELECT *, TA - (event_id % 12) AS TD, {_ES} AS es, {_DRY} AS dry FROM w), q AS (SELECT *, 1/(dry/(RH*0.0180153*es/(8.31451*TA))+1) AS QI FROM s)
SELECT event_id, round(1e3*RH*es/(TA*461.9), 6) AS ah, round(1e3*QI, 6) AS qi, round(least(1.0, QI/(1-QI)*dry/(0.0180153*es/(8.31451*TA))), 6) AS rh_qi,
 round(least(1.0, CASE WHEN TA >= 273.15 THEN {_RATIO(17.502, 240.97)} WHEN TA - 273.15 < -16 THEN {_RATIO(22.452, 272.55)} ELSE ({_ICE}*{_RATIO(22.452, 272.55)} + {_WATER}*{_RATIO(17.502, 240.97)})/({_ICE}+{_WATER}) END), 6) AS rh_td FROM q""")
def generator_humidity(spark, d):
    c = F.col
    w = weather(spark, d).withColumn("TD", c("TA") - c("event_id") % 12).withColumn("QI", air.specific_humidity(c("ALT"), c("TA"), c("RH")))
    r = lambda x, name: F.round(x, 6).alias(name)
    return w.select("event_id", r(1e3 * air.absolute_humidity(c("RH"), c("TA")), "ah"), r(1e3 * c("QI"), "qi"), r(air.relative_from_specific(c("ALT"), c("TA"), c("QI")), "rh_qi"), r(air.relative_humidity(c("TD"), c("TA")), "rh_td"))


@query(f"""WITH {WEATHER}, s AS (SELECT *, RH*{_ES} AS e FROM w) SELECT event_id, round(least(1.24*pow(0.01*e/TA,1/7.0),1)*{_SB}, 4) AS brutsaert, round(59.38+113.7*pow(TA/273.16,6)+96.96*sqrt(4650*e*0.001/TA/25), 4) AS dilley,
 round(least(1-(1+4650*e*0.001/TA)*exp(-sqrt(1.2+3*4650*e*0.001/TA)),1)*{_SB}, 4) AS prata, round(least(0.7+5.95e-5*e*0.01*exp(1500/TA),1)*{_SB}, 4) AS idso,
 round(least(0.97*(0.68+0.0036*sqrt(e))*(1+0.18*CLD*CLD),1)*{_SB}, 4) AS omstedt, round(((1-pow(CLD,4))*(0.23+0.484*pow(e/TA,1/8.0))+pow(CLD,4)*0.952)*{_SB}, 4) AS konzelmann, round((-0.34+3.36e-3*TA+1.94e-3*RH*100+0.213*CLD)*{_SB}, 4) AS carmona FROM s""")
def generator_longwave(spark, d):
    c = F.col
    clear = (R(air.clear_sky_longwave(k, c("RH"), c("TA")), k.lower()) for k in ("BRUTSAERT", "DILLEY", "PRATA", "IDSO"))
    cloudy = (R(air.all_sky_longwave(k, c("RH"), c("TA"), c("CLD")), k.lower()) for k in ("OMSTEDT", "KONZELMANN", "CARMONA"))
    return weather(spark, d).select("event_id", *clear, *cloudy)


@query(f"""WITH {WEATHER}, s AS (SELECT *, TA-273.15 AS c, RH*100 AS r, pow(VW*3.6, 0.16) AS p FROM w) SELECT event_id, round(CASE WHEN TA > 283.15 OR VW < 5 THEN TA ELSE 13.12+0.6215*c-11.37*p+0.3965*c*p+273.15 END, 4) AS wind_chill,
 round(CASE WHEN TA < 299.85 OR RH < 0.4 THEN TA ELSE -8.784695+1.61139411*c+2.338549*r-0.14611605*c*r-1.2308094e-2*c*c-1.6424828e-2*r*r+2.211732e-3*c*c*r+7.2546e-4*c*r*r-3.582e-6*c*c*r*r+273.15 END, 4) AS heat_index,
 round(-VW*sin(radians(DW)), 4) + 0 AS u, round(-VW*cos(radians(DW)), 4) + 0 AS v FROM s""")
def generator_indices(spark, d):
    c = F.col
    u, v = air.wind_components(c("VW"), c("DW"))
    return weather(spark, d).select("event_id", R(air.wind_chill(c("TA"), c("VW")), "wind_chill"), R(air.heat_index(c("TA"), c("RH")), "heat_index"), (F.round(u, 4) + 0).alias("u"), (F.round(v, 4) + 0).alias("v"))


@query(f"WITH {STATIONS}, {CELLS} SELECT region, cell, round(sum(w*value)/sum(w), 4) AS value FROM (SELECT ce.region, ce.cell, st.value, 1/sqrt(pow(ce.x-st.x,2)+pow(ce.y-st.y,2)+1e6) AS w FROM ce JOIN st USING (region)) GROUP BY ALL")
def spatial_idw(spark, d):
    return sp.idw(cells(spark, d), stations(spark, d)).select("region", "cell", R(F.col("value"), "value"))


@query(f"WITH {STATIONS}, {CELLS} SELECT region, cell, value FROM (SELECT ce.region, ce.cell, st.value, row_number() OVER (PARTITION BY ce.cell ORDER BY pow(ce.x-st.x,2)+pow(ce.y-st.y,2), st.station DESC) AS k FROM ce JOIN st USING (region)) WHERE k = 1")
def spatial_nearest(spark, d):
    return sp.nearest(cells(spark, d), stations(spark, d))


@query(f"WITH {STATIONS}, {CELLS}, m AS (SELECT region, avg(value) AS v FROM st GROUP BY region) SELECT region, cell, round(v, 4) AS value FROM ce JOIN m USING (region)")
def spatial_average(spark, d):
    return sp.average(cells(spark, d), stations(spark, d)).select("region", "cell", R(F.col("value"), "value"))


@query(f"""WITH {STATIONS}, {CELLS}, f AS (SELECT region, CASE WHEN var_pop(alt) > 0 THEN regr_slope(value, alt) ELSE 0 END AS s, avg(value) AS v, avg(alt) AS a FROM st GROUP BY region),
r AS (SELECT st.*, value - s*alt - (v - s*a) AS q FROM st JOIN f USING (region)), i AS (SELECT ce.region, ce.cell, ce.alt, sum(q/sqrt(pow(ce.x-r.x,2)+pow(ce.y-r.y,2)+1e6))/sum(1/sqrt(pow(ce.x-r.x,2)+pow(ce.y-r.y,2)+1e6)) AS q FROM ce JOIN r USING (region) GROUP BY ALL)
SELECT region, cell, round(q + s*alt + v - s*a, 3) AS value FROM i JOIN f USING (region)""")
def spatial_idw_lapse(spark, d):
    return sp.idw_lapse(cells(spark, d), stations(spark, d)).select("region", "cell", F.round("value", 3).alias("value"))


@query(f"WITH {OBS} SELECT station, round(quantile_cont(x, 0.1), 4) AS q10, round(quantile_cont(x, 0.5), 4) AS q50, round(quantile_cont(x, 0.9), 4) AS q90, round(var_samp(x), 4) AS variance, round(avg(x), 4) AS mean, min(x) AS lo, max(x) AS hi, round(regr_slope(x, event_id), 8) AS slope, count(x) AS n FROM obs GROUP BY station")
def stats_series(spark, d):
    q = F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return observations(spark, d).groupBy("station").agg(R(q[0], "q10"), R(q[1], "q50"), R(q[2], "q90"), R(F.var_samp("x"), "variance"), R(F.avg("x"), "mean"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.round(F.regr_slope("x", "event_id"), 8).alias("slope"), F.count("x").alias("n"))


@query(f"WITH {OBS}, b AS (SELECT station, min(x) AS lo, max(x) AS hi FROM obs GROUP BY station) SELECT station, least(CAST(floor((x-lo)/((hi-lo)/10)) AS INTEGER), 9) AS bin, count(*) AS n, round(avg(x), 8) AS mean FROM obs JOIN b USING (station) WHERE x IS NOT NULL AND hi > lo GROUP BY ALL")
def stats_equal_bins(spark, d):
    obs = observations(spark, d)
    ends = obs.groupBy("station").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("hi > lo")
    at = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 10)).cast("int"), F.lit(9))
    return obs.where("x IS NOT NULL").join(ends, "station").groupBy("station", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), R8(F.avg("x"), "mean"))


@query(f"WITH {OBS}, v AS (SELECT *, lag(x) OVER {W} AS a, lag(t_us) OVER {W} AS ta, lead(x) OVER {W} AS b, lead(t_us) OVER {W} AS tb FROM obs WHERE x IS NOT NULL) SELECT event_id, round(coalesce((b-a)/((tb-ta)/3.6e9), (b-x)/((tb-t_us)/3.6e9), (x-a)/((t_us-ta)/3.6e9)), 3) AS dx FROM v")
def stats_derivative(spark, d):
    s = _series()
    x, t = F.col("x"), F.col("t_us")
    a, ta, b, tb = F.lag(x).over(s), F.lag(t).over(s), F.lead(x).over(s), F.lead(t).over(s)
    rate = lambda dx, dt: dx / F.nullif(dt / 3.6e9, F.lit(0.0))
    return observations(spark, d).where("x IS NOT NULL").select("event_id", F.round(F.coalesce(rate(b - a, tb - ta), rate(b - x, tb - t), rate(x - a, t - ta)), 3).alias("dx"))


@query(f"WITH {OBS}, {_PAIRS} SELECT event_id, round(CASE WHEN p1 IS NULL THEN p2 WHEN p2 IS NULL THEN p1 ELSE 0.3*p2 + 0.7*p1 END, 8) AS x FROM pairs")
def filter_exp_smoothing(spark, d):
    return observations(spark, d).select("event_id", R8(co.exp_smoothing(F.col("x"), _series(), 2, 0.3), "x"))


_FRAME = "(PARTITION BY station ORDER BY t_us, event_id ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING)"


@query(f"""WITH {OBS}, a AS (SELECT *, median(x) OVER {_FRAME.format(n=2)} AS m5, stddev_samp(x) OVER {_FRAME.format(n=4)} AS sd FROM obs), b AS (SELECT *, median(m5) OVER {_FRAME.format(n=1)} AS m3 FROM a),
c AS (SELECT *, lag(m3) OVER {W} AS p, lead(m3) OVER {W} AS q, lag(1, 4) OVER {W} + lead(1, 4) OVER {W} AS inside FROM b),
u AS (SELECT *, (coalesce(p,0)+coalesce(2*m3,0)+coalesce(q,0)) / nullif((p IS NOT NULL)::INT+2*(m3 IS NOT NULL)::INT+(q IS NOT NULL)::INT, 0) AS u3 FROM c)
SELECT event_id, CASE WHEN inside IS NOT NULL AND abs(x - u3) > 1.5 * sd THEN NULL ELSE x END AS x FROM u""")
def filter_tukey(spark, d):
    return co.tukey(observations(spark, d), "station", ["t_us", "event_id"], "x", 1.5, fl.rows(_series(), 9)).select("event_id", "x")


@query(f"WITH {OBS} SELECT event_id, round(x + ((t_us // {HOUR}) % 24) / 10, 6) AS hourly, round(x * (1 + month(make_timestamp(t_us)) / 100), 6) AS monthly FROM obs")
def filter_add_mult(spark, d):
    """ADD by hour, MULT by month."""
    x, t = F.col("x"), F.col("t_us")
    hourly, monthly = x + co.by_period(t, "hour", [k / 10 for k in range(24)]), x * co.by_period(t, "month", [1 + k / 100 for k in range(1, 13)])
    return observations(spark, d).select("event_id", F.round(hourly, 6).alias("hourly"), F.round(monthly, 6).alias("monthly"))


_K = "CASE WHEN c > {a} THEN {k[0]} WHEN c > 0 THEN {k[1]} WHEN c > -5 THEN {k[2]} ELSE {k[3]} END"
_WATER = "611.73*exp(17.27*(TA-273.16)/(TA-35.86))"
_X = "(ALT/3)/(1.2*1004*TA*greatest(VW, 0.1))"


@query(f"""WITH {WEATHER}, v AS (SELECT *, TA - 273.15 AS c, VW * ln(2/0.03)/ln(10/0.03) AS v2 FROM w)
SELECT event_id, round(PSUM*exp({_K.format(a=1.67, k=(0.0146, 0.0294, 0.0527, 0.0889))}*v2), 4) AS unsh, round(PSUM*exp({_K.format(a=1.67, k=(0.0060, 0.0121, 0.0217, 0.0366))}*v2), 4) AS sh, round(PSUM*exp({_K.format(a=1.2, k=(0, 0.0294, 0.0527, 0.0889))}*v2), 4) AS hellmann,
 round(RH*{_WATER}/({_ES}), 6) AS rh_ice, CASE WHEN VW < 2 THEN NULL ELSE round(TA, 6) END AS calm, round(CASE WHEN {_X} >= 1e-4 THEN TA - (0.13 + 373.4*{_X}) ELSE TA END, 4) AS nakamura, round(CASE WHEN 1e3*{_X} >= 0.05 THEN TA - 3.1*sqrt(1e3*{_X}) ELSE TA END, 4) AS huwald FROM v""")
def filter_corrections(spark, d):
    """UNDERCATCH_HAMON, RHWATERTOICE and UNVENTILATED_T."""
    c = F.col
    caught = (R(co.undercatch_hamon(c("PSUM"), c("TA"), c("VW"), g), n) for g, n in (("unsh", "unsh"), ("sh", "sh"), ("hellmannsh", "hellmann")))
    error = (R(co.radiation_error(c("TA"), c("VW"), c("ALT") / 3, s), s.lower()) for s in ("NAKAMURA", "HUWALD"))
    return weather(spark, d).select("event_id", *caught, F.round(co.humidity_over_ice(c("RH"), c("TA")), 6).alias("rh_ice"), F.round(co.calm_temperature(c("TA"), c("VW"), 2.0), 6).alias("calm"), *error)


@query(f"WITH {OBS} SELECT station, t_us // {HOUR} * {HOUR} AS t_us, round(avg(x), 6) AS x FROM obs GROUP BY ALL")
def time_cleanup(spark, d):
    """CLEANUP of times rounded down to hours."""
    rounded = observations(spark, d).withColumn("t_us", (F.floor(F.col("t_us") / HOUR) * HOUR).cast("long"))
    return co.clean_up(rounded, ["station", "t_us"], ["x"]).withColumn("x", F.round("x", 6))


@query(f"""WITH {OBS} SELECT event_id, round(coalesce(x, 30*sin(2*pi()*(((t_us + {DAY // 2}) % {DAY})/{DAY}.0 + 0.25)) + 50), 6) AS daily, round(coalesce(x, 30*sin(2*pi()*(dayofyear(make_timestamp(t_us))/366.25 - 0.25)) + 50), 6) AS yearly FROM obs""")
def generator_sin(spark, d):
    x, t = F.col("x"), F.col("t_us")
    return observations(spark, d).select("event_id", F.round(ge.filled(x, ge.daily_sinusoid(t, 20.0, 80.0)), 6).alias("daily"), F.round(ge.filled(x, ge.yearly_sinusoid(t, 20.0, 80.0)), 6).alias("yearly"))


@query(f"""WITH {WEATHER}, h AS (SELECT *, CASE WHEN event_id % 5 > 0 THEN PSUM/20 END AS HS, ALT/3 AS R FROM w), p AS (SELECT *, CASE WHEN HS IS NULL THEN 0.98175 WHEN HS > 0.1 THEN 0.983 ELSE 0.9805 END AS e, CASE WHEN HS >= 0.1 THEN 0.85 WHEN HS < 0.1 THEN 0.23 END AS al, greatest(0, least(1, (TA - 271.15)/4)) AS f FROM h)
SELECT event_id, round(pow((200 + R/5)/(e*5.670373e-8), 0.25), 4) AS tss, round(CASE WHEN R <= 4 THEN R ELSE R/al END, 4) AS iswr, round(CASE WHEN R <= 4 THEN R ELSE R*al END, 4) AS rswr, round(CASE WHEN PSUM = 0 THEN 0 ELSE f END, 6) AS phase, round(PSUM*f, 6) AS liquid, round(PSUM*(1-f), 6) AS solid FROM p""")
def generator_fill(spark, d):
    """TS_OLWR, ISWR_ALBEDO and PRECSPLITTING with a range of temperatures."""
    c, none = F.col, F.lit(None).cast("double")
    w = weather(spark, d).withColumns({"HS": F.when(c("event_id") % 5 > 0, c("PSUM") / 20), "R": c("ALT") / 3})
    _, phase, liquid, solid = ge.split_precipitation(c("PSUM"), none, none, none, ge.rain_fraction(c("TA"), 271.15, 275.15))
    radiation = (R(ge.surface_temperature(200 + c("R") / 5, c("HS")), "tss"), R(ge.incoming_from_reflected(c("R"), c("HS")), "iswr"), R(ge.reflected_from_incoming(c("R"), c("HS")), "rswr"))
    return w.select("event_id", *radiation, F.round(phase, 6).alias("phase"), F.round(liquid, 6).alias("liquid"), F.round(solid, 6).alias("solid"))


@query(f"""WITH {_TYPES}, o AS (SELECT station, t_us, min(x) AS x FROM obs0 GROUP BY ALL), s AS (SELECT *, lag(t_us) OVER (PARTITION BY station ORDER BY t_us) AS a FROM o),
k AS (SELECT station, x, a, t_us AS b, unnest(generate_series(a // {HOUR}, (t_us - 1) // {HOUR})) AS k FROM s WHERE x IS NOT NULL AND a IS NOT NULL)
SELECT station, (k + 1) * {HOUR} AS t_us, round(sum(x * (least(b, (k+1)*{HOUR}) - greatest(a, k*{HOUR})) / (b - a)), 6) AS x FROM k GROUP BY ALL""")
def resample_accumulate(spark, d):
    return se.accumulate(_dense(spark, d), "station", "t_us", "x", HOUR).withColumn("x", F.round("x", 6))


@query(f"WITH {STATIONS}, {CELLS}, f AS (SELECT region, CASE WHEN var_pop(alt) > 0 THEN regr_slope(value, alt) ELSE 0 END AS s, avg(value) AS v, avg(alt) AS a FROM st GROUP BY region) SELECT region, cell, round(s*alt + v - s*a, 3) AS value FROM ce JOIN f USING (region)")
def spatial_average_lapse(spark, d):
    return sp.average_lapse(cells(spark, d), stations(spark, d)).select("region", "cell", F.round("value", 3).alias("value"))


@query(f"""WITH {STATIONS}, {CELLS}, n AS (SELECT ce.region, ce.cell, ce.alt, st.value, st.alt AS salt, 1/sqrt(pow(ce.x-st.x,2)+pow(ce.y-st.y,2)+1e6) AS w, row_number() OVER (PARTITION BY ce.region, ce.cell ORDER BY pow(ce.x-st.x,2)+pow(ce.y-st.y,2), st.station) AS k FROM ce JOIN st USING (region)),
g AS (SELECT region, cell, any_value(alt) AS alt, CASE WHEN var_pop(salt) > 0 THEN regr_slope(value, salt) ELSE 0 END AS s, avg(value) AS v, avg(salt) AS a FROM n WHERE k <= 4 GROUP BY ALL)
SELECT region, cell, round(sum(w*(n.value - s*salt - (v - s*a)))/sum(w) + any_value(s*g.alt + v - s*a), 3) AS value FROM n JOIN g USING (region, cell) WHERE k <= 4 GROUP BY ALL""")
def spatial_local_lapse(spark, d):
    return sp.local_idw_lapse(cells(spark, d), stations(spark, d), 4).select("region", "cell", F.round("value", 3).alias("value"))


_AT = lambda name, di, dj: f"LEFT JOIN dem {name} ON {name}.i = c.i + {di} AND {name}.j = c.j + {dj}"
_AROUND = " ".join(_AT(n, i, j) for n, i, j in (("sw", -1, -1), ("s", 0, -1), ("se", 1, -1), ("w", -1, 0), ("e", 1, 0), ("nw", -1, 1), ("n", 0, 1), ("ne", 1, 1)))
_DEM = f"WITH {ELEVATIONS}, a AS (SELECT c.i, c.j, c.value AS z, " + ", ".join(f"{k}.value AS {k}" for k in "sw s se w e nw n ne".split()) + f" FROM dem c {_AROUND})"
_NORMALS = {"horn": ("(nw+2*w+sw-ne-2*e-se)/800", "(sw+2*s+se-nw-2*n-ne)/800"), "fleming": ("(w-e)/200", "(s-n)/200"), "corripio": ("(sw+nw-se-ne)/400", "(sw-nw+se-ne)/400")}

for _name, (_nx, _ny) in _NORMALS.items():

    def _terrain(spark, d, scheme=_name.upper()):
        out = te.slope_aspect(elevations(spark, d), 100.0, scheme)
        return out.select("i", "j", R(F.col("slope"), "slope"), R(F.col("azimuth"), "azimuth"), R(te.hillshade(F.col("slope"), F.col("azimuth"), 30.0, 315.0), "shade"))

    QUERIES[f"terrain_{_name}"] = _terrain
    ORACLES[f"terrain_{_name}"] = f"""{_DEM}, g AS (SELECT i, j, CASE WHEN z IS NOT NULL THEN {_nx} END AS x, CASE WHEN z IS NOT NULL THEN {_ny} END AS y FROM a), h AS (SELECT *, degrees(atan(sqrt(x*x + y*y))) AS slope FROM g),
k AS (SELECT *, CASE WHEN slope IS NULL THEN NULL WHEN slope = 0 THEN 0 WHEN x = 0 THEN CASE WHEN y < 0 THEN 180 ELSE 0 END ELSE (450 - round(degrees(atan2(y, x)), 1)) % 360 END AS az FROM h)
SELECT i, j, round(slope, 4) AS slope, round(az, 4) AS azimuth, round(greatest(0, cos(radians(60))*cos(radians(slope)) + sin(radians(60))*sin(radians(slope))*cos(radians(315 - az))), 4) + CASE WHEN slope IS NULL THEN NULL ELSE 0 END AS shade FROM k"""


_RISE = "CASE WHEN coalesce({a}, {b}) IS NOT NULL THEN (z - (coalesce({a}, z) + coalesce({b}, z))/2)/{d} END"


@query(f"""{_DEM}, r AS (SELECT i, j, z, [{_RISE.format(a='w', b='e', d=200)}, {_RISE.format(a='s', b='n', d=200)}, {_RISE.format(a='sw', b='ne', d='(200*sqrt(2))')}, {_RISE.format(a='nw', b='se', d='(200*sqrt(2))')}] AS l FROM a)
SELECT i, j, CASE WHEN z IS NOT NULL THEN round(list_avg(l), 6) END AS curvature FROM r""")
def terrain_curvature(spark, d):
    return te.curvature(elevations(spark, d), 100.0).select("i", "j", F.round("curvature", 6).alias("curvature"))


@query(f"""WITH {WEATHER} SELECT station, round(corr(TA, TSS), 6) AS corr, round(1 - sum(pow(TA - TSS, 2))/nullif(sum(pow(TA, 2)) - pow(sum(TA), 2)/count(*), 0), 4) AS nash_sutcliffe, round(sum(VW*TA)/nullif(sum(VW), 0), 6) AS weighted FROM w GROUP BY station HAVING count(*) > 2""")
def stats_pairs(spark, d):
    """Correlation, model efficiency and weighted mean of two parameters."""
    c = F.col
    spread = F.sum(c("TA") * c("TA")) - F.pow(F.sum("TA"), 2) / F.count(F.lit(1))
    agg = weather(spark, d).groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("TA", "TSS"), 6).alias("corr"), R(1 - F.sum(F.pow(c("TA") - c("TSS"), 2)) / F.nullif(spread, F.lit(0.0)), "nash_sutcliffe"), F.round(F.sum(c("VW") * c("TA")) / F.nullif(F.sum("VW"), F.lit(0.0)), 6).alias("weighted"))
    return agg.where("n > 2").drop("n")


@query(f"""WITH {_TYPES}, o AS (SELECT station, t_us, min(x) AS x FROM obs0 GROUP BY ALL), d AS (SELECT station, (t_us - 1) // {DAY} AS day, avg(x) AS v FROM o WHERE x IS NOT NULL GROUP BY ALL),
g AS (SELECT station, unnest(generate_series(CAST(ceil(min(t_us)/{HOUR}.0) AS BIGINT), CAST(floor(max(t_us)/{HOUR}.0) AS BIGINT)))*{HOUR} AS t_us FROM o GROUP BY station),
p AS (SELECT g.station, g.t_us, (t_us - (t_us - 1) // {DAY} * {DAY})/{DAY}.0 AS f, b.v AS v1, a.v AS v0, c.v AS v2 FROM g LEFT JOIN d b ON b.station = g.station AND b.day = (t_us - 1) // {DAY} LEFT JOIN d a ON a.station = b.station AND a.day = b.day - 1 LEFT JOIN d c ON c.station = b.station AND c.day = b.day + 1)
SELECT station, t_us, round(10*sin(2*pi()*(f - 0.25)) + CASE WHEN f = 0.5 THEN v1 ELSE (v1/pow(f-0.5, 2) + coalesce(v0/pow(f+0.5, 2), 0) + coalesce(v2/pow(f-1.5, 2), 0)) / (1/pow(f-0.5, 2) + CASE WHEN v0 IS NULL THEN 0 ELSE 1/pow(f+0.5, 2) END + CASE WHEN v2 IS NULL THEN 0 ELSE 1/pow(f-1.5, 2) END) END, 8) AS x FROM p""")
def resample_daily_average(spark, d):
    obs = _dense(spark, d)
    out = se.daily_average(obs, se.grid_of(obs, "station", "t_us", HOUR), "station", "t_us", "x", 10.0)
    return out.select("station", "t_us", R8(F.col("x"), "x"))


#: The first day of the observations, and days counted from there.
_FIRST = 19_723 * DAY


def _days(a: int, b: int) -> tuple[int, int]:
    return _FIRST + a * DAY, _FIRST + b * DAY


@query(f"WITH {OBS} SELECT event_id, t_us, x FROM obs WHERE NOT (t_us BETWEEN {_days(3, 5)[0]} AND {_days(3, 5)[1]} OR t_us BETWEEN {_days(10, 11)[0]} AND {_days(10, 11)[1]})")
def time_suppress(spark, d):
    return se.suppress(observations(spark, d), "t_us", [_days(3, 5), _days(10, 11)]).select("event_id", "t_us", "x")


@query(f"WITH {OBS} SELECT event_id, t_us + CASE WHEN t_us >= {_days(20, 20)[0]} THEN 0 WHEN t_us >= {_days(5, 5)[0]} THEN -3600000000 ELSE 0 END AS t_us FROM obs")
def time_shift_steps(spark, d):
    return observations(spark, d).select("event_id", se.shift_steps(F.col("t_us"), [(_days(5, 5)[0], -3600.0), (_days(20, 20)[0], 0.0)]).alias("t_us"))


@query(f"""WITH {OBS}, r AS (SELECT event_id, t_us, x, unnest(generate_series(-2, 10)) AS k FROM obs WHERE t_us >= {_days(0, 7)[0]} AND t_us < {_days(0, 7)[1]})
SELECT event_id, t_us + k * {7 * DAY} AS t_us, x FROM r WHERE t_us + k * {7 * DAY} BETWEEN {_days(3, 40)[0]} AND {_days(3, 40)[1]}""")
def time_loop(spark, d):
    return se.time_loop(observations(spark, d), "t_us", _days(0, 7), _days(3, 40)).select("event_id", "t_us", "x")


_STD = "101325*pow(1 - 0.0065*6356766*{a}/(288.15*(6356766 + {a})), 9.80665/(0.0065*287.058))"
_WEIGHT = "1/sqrt(pow(ce.x-q.x, 2) + pow(ce.y-q.y, 2) + 1e6)"


@query(f"""WITH {STATIONS}, {CELLS}, q AS (SELECT region, x, y, value + 90000 - {_STD.format(a='alt')} AS r FROM st), m AS (SELECT region, avg(r) AS r FROM q GROUP BY region),
i AS (SELECT ce.region, ce.cell, sum(q.r * {_WEIGHT}) / sum({_WEIGHT}) AS r FROM ce JOIN q USING (region) GROUP BY ALL)
SELECT region, cell, round(m.r + {_STD.format(a='alt')}, 2) AS by_mean, round(i.r + {_STD.format(a='alt')}, 2) AS by_idw FROM ce JOIN m USING (region) JOIN i USING (region, cell)""")
def spatial_std_pressure(spark, d):
    ce, st = cells(spark, d), stations(spark, d).withColumn("value", F.col("value") + 90_000)
    mean, near = sp.std_pressure(ce, st), sp.std_pressure(ce, st, 1000.0)
    return mean.select("region", "cell", F.round("value", 2).alias("by_mean")).join(near.select("region", "cell", F.round("value", 2).alias("by_idw")), ["region", "cell"])


@query(f"""WITH {STATIONS}, {CELLS}, q AS (SELECT region, x, y, -(station % 20)*sin(radians(station*37 % 360)) AS u, -(station % 20)*cos(radians(station*37 % 360)) AS v FROM st),
i AS (SELECT ce.region, ce.cell, sum(q.u * {_WEIGHT}) / sum({_WEIGHT}) AS u, sum(q.v * {_WEIGHT}) / sum({_WEIGHT}) AS v FROM ce JOIN q USING (region) GROUP BY ALL)
SELECT region, cell, round(sqrt(u*u + v*v), 4) AS vw, round((degrees(atan2(u, v)) + 180) % 360, 3) AS dw FROM i""")
def spatial_idw_wind(spark, d):
    k = F.col("station")
    st = stations(spark, d).withColumns({"vw": (k % 20).cast("double"), "dw": (k * 37 % 360).cast("double")})
    return sp.idw_wind(cells(spark, d), st).select("region", "cell", R(F.col("vw"), "vw"), F.round("dw", 3).alias("dw"))


@query(f"""WITH {STATIONS}, {CELLS}, e AS (SELECT region, x, y, alt, least((200 + station % 100)/(5.670373e-8*pow(270 + station % 20, 4)), 1) AS value FROM st), f AS (SELECT region, CASE WHEN var_pop(alt) > 0 THEN regr_slope(value, alt) ELSE 0 END AS s, avg(value) AS v, avg(alt) AS a FROM e GROUP BY region),
q AS (SELECT e.region, x, y, value - s*alt - (v - s*a) AS r FROM e JOIN f USING (region)), i AS (SELECT ce.region, ce.cell, any_value(ce.alt) AS alt, sum(q.r * {_WEIGHT}) / sum({_WEIGHT}) AS r FROM ce JOIN q USING (region) GROUP BY ALL)
SELECT region, cell, round((r + s*alt + v - s*a) * 5.670373e-8*pow(265 + cell % 25, 4), 3) AS value FROM i JOIN f USING (region)""")
def spatial_longwave(spark, d):
    """ILWR_EPS."""
    k = F.col("station")
    st = stations(spark, d).withColumns({"value": (200 + k % 100).cast("double"), "ta": (270 + k % 20).cast("double")})
    return sp.longwave_by_emissivity(cells(spark, d).withColumn("ta", (265 + F.col("cell") % 25).cast("double")), st).select("region", "cell", F.round("value", 3).alias("value"))


_WET = "CASE WHEN {c} >= 0 THEN {w} WHEN {c} < -16 THEN {i} ELSE ({i}/(pow({c}+16, 2)+1e-6) + {w}/(pow({c}, 2)+1e-6))/(1/(pow({c}+16, 2)+1e-6) + 1/(pow({c}, 2)+1e-6)) END"
_DEW = "{k}*(ln(rh) + {b}*c/({k}+c))/({b} - ln(rh) - {b}*c/({k}+c))"
_RELATIVE = "exp({b}*d/({k}+d) - {b}*c/({k}+c))"


@query(f"""WITH {STATIONS}, {CELLS}, h AS (SELECT region, x, y, alt, (1 + station % 95)/100.0::DOUBLE + 0.0001 AS rh, station*7 % 40 - 24.15::DOUBLE AS c FROM st WHERE station % 11 <> 0),
e AS (SELECT region, x, y, alt, {_WET.format(c="c", w=_DEW.format(k=240.97, b=17.502), i=_DEW.format(k=272.55, b=22.452))} AS value FROM h),
f AS (SELECT region, CASE WHEN var_pop(alt) > 0 THEN regr_slope(value, alt) ELSE 0 END AS s, avg(value) AS v, avg(alt) AS a FROM e GROUP BY region), q AS (SELECT e.region, x, y, value - s*alt - (v - s*a) AS r FROM e JOIN f USING (region)),
i AS (SELECT ce.region, ce.cell, any_value(ce.alt) AS alt, sum(q.r * {_WEIGHT}) / sum({_WEIGHT}) AS r FROM ce JOIN q USING (region) GROUP BY ALL),
t AS (SELECT region, cell, cell % 40 - 24.15::DOUBLE AS c, r + s*alt + v - s*a AS d FROM i JOIN f USING (region))
SELECT region, cell, round(least(1, {_WET.format(c="c", w=_RELATIVE.format(k=240.97, b=17.502), i=_RELATIVE.format(k=272.55, b=22.452))}), 5) AS value FROM t""")
def spatial_humidity(spark, d):
    """LISTON_RH; every eleventh station has no humidity."""
    k = F.col("station")
    st = stations(spark, d).withColumns({"rh": F.when(k % 11 != 0, (1 + k % 95) / 100.0), "ta": k * 7 % 40 + 249.0})
    return sp.humidity_by_dew_point(cells(spark, d).withColumn("ta", F.col("cell") % 40 + 249.0), st).select("region", "cell", F.round("value", 5).alias("value"))


@query(f"""WITH {STATIONS}, {CELLS}, e AS (SELECT region, x, y, alt, 268 + station % 12 AS value FROM st), f AS (SELECT region, CASE WHEN var_pop(alt) > 0 THEN regr_slope(value, alt) ELSE 0 END AS s, avg(value) AS v, avg(alt) AS a FROM e GROUP BY region),
q AS (SELECT e.region, x, y, value - s*alt - (v - s*a) AS r FROM e JOIN f USING (region)), i AS (SELECT ce.region, ce.cell, any_value(ce.alt) AS alt, sum(q.r * {_WEIGHT}) / sum({_WEIGHT}) AS r FROM ce JOIN q USING (region) GROUP BY ALL),
t AS (SELECT region, cell, r + s*alt + v - s*a AS ta FROM i JOIN f USING (region)) SELECT region, cell, CASE WHEN ta >= 273.35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS by_threshold, round(least(1, greatest(0, (ta - 272.15)/2)), 5) AS by_range FROM t""")
def spatial_precipitation_phase(spark, d):
    """PPHASE of both kinds over interpolated air temperature."""
    ta = sp.idw_lapse(cells(spark, d), stations(spark, d).withColumn("value", (268 + F.col("station") % 12).cast("double")))
    v = F.col("value")
    return ta.select("region", "cell", sp.rain_share(v, 273.35).alias("by_threshold"), F.round(sp.rain_share(v, 274.15, 272.15), 5).alias("by_range"))


@query(f"""WITH {WEATHER}, a AS (SELECT event_id, t_us, CLD, LAT, (event_id*17)%360 - 180 AS lon, (t_us/86400000000.0::DOUBLE - 10957.5)/36525 AS c FROM w),
b AS (SELECT *, 280.46646::DOUBLE + c*(36000.76983::DOUBLE + c*0.0003032::DOUBLE) AS l, radians(357.52911::DOUBLE + c*(35999.05029::DOUBLE - c*0.0001537::DOUBLE)) AS m, 0.016708634::DOUBLE - c*(0.000042037::DOUBLE + c*0.0000001267::DOUBLE) AS e, radians(125.04 - 1934.136*c) AS n FROM a),
d AS (SELECT *, radians(l + sin(m)*(1.914602::DOUBLE - c*(0.004817 + c*0.000014)) + sin(2*m)*(0.019993::DOUBLE - c*0.000101) + sin(3*m)*0.000289 - 0.00569 - 0.00478*sin(n)) AS s, radians(23.439291::DOUBLE - c*(0.0130042::DOUBLE + c*(1.64e-7 - c*5.04e-7)) + 0.00256*cos(n)) AS o, radians(2*l) AS l2 FROM b),
f AS (SELECT *, asin(sin(o)*sin(s)) AS decl, pow(tan(o/2), 2) AS y FROM d), g AS (SELECT *, 4*degrees(y*sin(l2) - 2*e*sin(m) + 4*e*y*sin(m)*cos(l2) - y*y*sin(2*l2)/2 - 1.25*e*e*sin(2*m)) AS eq FROM f),
h AS (SELECT *, radians((((t_us % 86400000000)/60000000.0::DOUBLE + eq + 4*lon) % 1440 + 1440) % 1440 / 4 - 180) AS hour, radians(LAT) AS p FROM g),
i AS (SELECT *, degrees(asin(greatest(-1, least(1, sin(p)*sin(decl) + cos(p)*cos(decl)*cos(hour))))) AS el, -tan(p)*tan(decl) AS x FROM h)
SELECT event_id, round(degrees(decl), 6) AS declination, round(el, 6) AS elevation, round((degrees(atan2(sin(hour), cos(hour)*sin(p) - tan(decl)*cos(p))) + 180) % 360, 3) AS azimuth, round(eq, 6) AS equation, round(CASE WHEN el < 0 THEN 0 ELSE 1366.1*(1 + e)*sin(radians(el)) END, 4) AS top,
 round(CASE WHEN x <= -1 THEN 24 WHEN x >= 1 THEN 0 ELSE degrees(acos(x))*2/15 END, 6) AS hours, round(1 - 0.75*pow(CLD, 3.4), 6) AS clearness, round(least(1, pow((1 - CLD)/0.75, 1/3.4)), 6) AS cloudiness FROM i""")
def solar_position(spark, d):
    """Sun position, radiation above the atmosphere, length of the day, clearness and cloudiness."""
    w = weather(spark, d)
    s = sun.sun(F.col("t_us"), F.col("LAT"), F.col("event_id") * 17 % 360 - 180)
    six = lambda c, name: F.round(c, 6).alias(name)
    return w.select(
        "event_id", six(s.declination, "declination"), six(s.elevation, "elevation"), F.round(s.azimuth, 3).alias("azimuth"), six(s.equation, "equation"), R(sun.top_radiation(s), "top"),
        six(sun.day_length(s, F.col("LAT")), "hours"), six(sun.clearness(F.col("CLD")), "clearness"), six(sun.cloudiness(F.col("CLD")), "cloudiness"),
    )


@query(f"""WITH {STATIONS}, {CELLS}, q0 AS (SELECT * FROM st), f AS (SELECT region, count(*) AS n, CASE WHEN var_pop(alt) > 0 THEN regr_slope(value, alt) ELSE 0 END AS s, avg(value) AS v, avg(alt) AS a FROM q0 GROUP BY region),
q AS (SELECT q0.region, x, y, value - s*alt - (v - s*a) AS r FROM q0 JOIN f USING (region)), i AS (SELECT ce.region, ce.cell, sum(q.r * {_WEIGHT}) / sum({_WEIGHT}) AS r FROM ce JOIN q USING (region) GROUP BY ALL)
SELECT region, cell, round(greatest(-500, least(9000, CASE WHEN n IS NULL THEN 7 WHEN n = 1 THEN v WHEN n = 2 THEN s*alt + v - s*a ELSE r + s*alt + v - s*a END)), 3) AS value, CASE WHEN n IS NULL THEN 'CST' WHEN n = 1 THEN 'AVG' WHEN n = 2 THEN 'AVG_LAPSE' ELSE 'IDW_LAPSE' END AS algorithm
FROM ce LEFT JOIN f USING (region) LEFT JOIN i USING (region, cell)""")
def spatial_best(spark, d):
    """The algorithm that suits each region's number of stations best."""
    out = sp.interpolate(cells(spark, d), stations(spark, d), ["AVG_LAPSE", "AVG", "IDW_LAPSE", "CST"], 7.0, (-500.0, 9000.0))
    return out.select("region", "cell", F.round("value", 3).alias("value"), "algorithm")


@query(ORACLES["spatial_best"])
def spatial_best_all(spark, d):
    """The algorithm that suits each region's number of stations best, over all stations."""
    out = sp.interpolate(cells(spark, d), stations(spark, d), ["AVG_LAPSE", "AVG", "IDW_LAPSE", "CST"], 7.0, (-500.0, 9000.0))
    return out.select("region", "cell", F.round("value", 3).alias("value"), "algorithm")


def _frames(points: int, seconds: int) -> str:
    """CTEs up to f: the first and last row of each frame, from the places of the rows a span before and after."""
    s = seconds * 1_000_000
    at = lambda t: f"(SELECT min(q.i) FROM p q WHERE q.station = p.station AND q.t_us >= {t})"
    return f"""WITH {_TYPES}, o AS (SELECT station, t_us, min(x) AS x FROM obs0 GROUP BY station, t_us),
    p AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY t_us) - 1 AS i, count(*) OVER (PARTITION BY station) AS n, min(t_us) OVER (PARTITION BY station) AS t0, max(t_us) OVER (PARTITION BY station) AS tn FROM o),
    s AS (SELECT *, (SELECT max(q.i) FROM p q WHERE q.station = p.station AND q.t_us <= p.t_us - {s}) AS s1, {at(f"p.t_us + {s}")} AS e1,
     (SELECT max(q.i) FROM p q WHERE q.station = p.station AND q.t_us <= p.t_us - {s // 2}) AS s2, {at(f"p.t_us + {s // 2}")} AS e2, {at(f"p.t0 + {s}")} AS head, CASE WHEN tn - {s} >= t0 THEN {at(f"p.tn - {s}")} END AS tail FROM p),
    c AS (SELECT *, greatest(i - s2, {points // 2}) AS cl, greatest(e2 - i, {points // 2}) AS cr, i - greatest(i - coalesce(s1, 0), least({points - 1}, i)) AS ls, i + greatest(coalesce(e1, n - 1) - i, least({points - 1}, n - 1 - i)) AS re FROM s),
    f AS (SELECT station, t_us, 'left_hard' AS kind, x, least(s1, i - {points - 1}) AS a, i AS b FROM c WHERE s1 IS NOT NULL AND i >= {points - 1}
     UNION ALL SELECT station, t_us, 'right_hard', x, i, greatest(e1, i + {points - 1}) FROM c WHERE e1 IS NOT NULL AND i + {points - 1} < n
     UNION ALL SELECT station, t_us, 'center_hard', x, i - cl, i + cr FROM c WHERE cl = cr AND s2 IS NOT NULL AND e2 IS NOT NULL AND i >= {points // 2} AND i + {points // 2} < n
     UNION ALL SELECT * FROM (SELECT station, t_us, 'left_soft', x, ls, i + greatest(CASE WHEN s1 IS NULL THEN coalesce(head, n - 1) - i ELSE 0 END, {points} - (i - ls + 1)) AS b FROM c WHERE b < n)
     UNION ALL SELECT * FROM (SELECT station, t_us, 'right_soft', x, i - greatest(CASE WHEN e1 IS NOT NULL OR tail = i THEN 0 ELSE i - tail + 1 END, {points} - (re - i + 1)) AS a, re FROM c WHERE a >= 0 AND (e1 IS NOT NULL OR tail > 0))),
    g AS (SELECT f.station, f.t_us, f.kind, list(p.x) FILTER (p.x IS NOT NULL) AS l FROM f JOIN p ON p.station = f.station AND p.i BETWEEN f.a AND f.b GROUP BY ALL),
    k AS (SELECT p.station, p.t_us, p.x, kind, l FROM p CROSS JOIN (SELECT unnest(['left_hard', 'right_hard', 'center_hard', 'left_soft', 'right_soft']) AS kind) LEFT JOIN g USING (station, t_us, kind))"""


KINDS = {"left_hard": ("left", False), "right_hard": ("right", False), "center_hard": ("center", False), "left_soft": ("left", True), "right_soft": ("right", True)}


@query(_frames(5, 86_400) + "SELECT station, t_us, kind, round(CASE WHEN len(l) >= 2 THEN CASE WHEN abs(x - list_avg(l)) <= 1.5 * list_stddev_samp(l) THEN x END WHEN kind LIKE '%soft' THEN x END, 4) AS x FROM k")
def frame_std_dev(spark, d):
    """STD_DEV on frames of at least five rows and a day."""
    return fr.std_devs(_dense(spark, d), "station", "t_us", "x", KINDS, 1.5, 5, 86_400).select("station", "t_us", "kind", R(F.col("x"), "x"))


@query(_frames(5, 86_400) + ", m AS (SELECT *, list_median(l) AS md FROM k) SELECT station, t_us, kind, round(CASE WHEN abs(x - md) > 3 * greatest(list_median(list_transform(l, lambda v: abs(v - md))) / 0.6745, 2.0) THEN NULL ELSE x END, 4) AS x FROM m")
def frame_mad(spark, d):
    """MAD on frames of at least five rows and a day."""
    return fr.mads(_dense(spark, d), "station", "t_us", "x", KINDS, 2.0, 5, 86_400).select("station", "t_us", "kind", R(F.col("x"), "x"))


def _iir_sql(cutoff: float, response: str, g: str, p: str, c: str, both: bool) -> str:
    """One row after the other; the places of missing values decide which rows keep theirs."""
    ratio = f"(1 / ({c}))" if response == "LP" else f"({c})"
    f = f"{ratio} / {cutoff} / ((n - 1) / ((tn - t0) / 1e6))"
    sign = "1" if response == "LP" else "-1"
    sql = f"""WITH RECURSIVE {_TYPES}, o AS (SELECT station, t_us, min(x) AS x FROM obs0 GROUP BY station, t_us),
    e AS (SELECT station, min(t_us) AS t0, max(t_us) AS tn, count(*) AS n FROM o GROUP BY station), w AS (SELECT station, tan(pi() * ({f if response == "LP" else f"0.5 - {f}"})) AS w FROM e),
    k AS (SELECT station, {p} * w AS k1, {g} * w * w AS k2 FROM w), a AS (SELECT station, k2 / (1 + k1 + k2) AS a0, k2 FROM k),
    b AS (SELECT station, a0, 2 * a0 * (1 / k2 - 1) AS b1, 1 - (4 * a0 + 2 * a0 * (1 / k2 - 1)) AS b2 FROM a)"""
    source = "o"
    for k, order in enumerate(["DESC", "ASC"] if both else ["ASC"]):
        sql += f""",
    i{k} AS (SELECT station, t_us, x, row_number() OVER (PARTITION BY station ORDER BY t_us {order}) AS i, lag(x, 1) OVER (PARTITION BY station ORDER BY t_us {order}) AS x1, lag(x, 2) OVER (PARTITION BY station ORDER BY t_us {order}) AS x2 FROM {source}),
    r{k} AS (SELECT station, i, t_us, x AS y, NULL::DOUBLE AS y1 FROM i{k} WHERE i = 1 UNION ALL
     SELECT r.station, d.i, d.t_us, CASE WHEN d.x + d.x1 + d.x2 IS NULL THEN d.x ELSE b.a0 * d.x + {sign} * 2 * b.a0 * d.x1 + b.a0 * d.x2 + {sign} * b.b1 * r.y + b.b2 * r.y1 END, r.y
     FROM r{k} r JOIN i{k} d ON d.station = r.station AND d.i = r.i + 1 JOIN b ON b.station = r.station),
    s{k} AS (SELECT station, t_us, y AS x FROM r{k})"""
        source = f"s{k}"
    return sql + f" SELECT station, t_us, round(x, 4) AS x FROM {source}"


@query(_iir_sql(86_400, "LP", "1.0", "2.0", "sqrt(pow(2, 0.25) - 1)", True))
def filter_iir(spark, d):
    """IIR, low pass of two poles over a day, backward and forward."""
    return rc.iir(_dense(spark, d), "station", "t_us", "x", 86_400).select("station", "t_us", R(F.col("x"), "x"))


@query(_iir_sql(500_000, "LP", "1.0", "sqrt(2)", "1 / pow(sqrt(2) - 1, 0.25)", False))
def filter_low_pass(spark, d):
    """IIR, Butterworth low pass, forward only."""
    return rc.iir(_dense(spark, d), "station", "t_us", "x", 500_000, kind="BUTTERWORTH", both_ways=False).select("station", "t_us", R(F.col("x"), "x"))


@query(_iir_sql(172_800, "HP", "3.0", "3.0", "sqrt(sqrt(pow(2, 0.5) - 0.75) - 0.5) / sqrt(3)", True))
def filter_high_pass(spark, d):
    """IIR, Bessel high pass, backward and forward."""
    return rc.iir(_dense(spark, d), "station", "t_us", "x", 172_800, "HP", "BESSEL").select("station", "t_us", R(F.col("x"), "x"))


_GAPS = f"""WITH {_TYPES}, o AS (SELECT station, t_us, min(CASE WHEN (t_us // {DAY // 2}) % 5 <> 3 AND (t_us // {DAY}) % 17 <> 4 AND (t_us // {DAY}) % 17 <> 5 THEN x END) AS x FROM obs0 GROUP BY station, t_us),
e AS (SELECT station, min(t_us) AS t0, max(t_us) AS tn FROM o GROUP BY station),
a AS (SELECT station, t0, tn, unnest(generate_series(t0 // {HOUR} - 30, tn // {HOUR} + 30)) * {HOUR} AS t_us FROM e),
v AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY t_us) AS k FROM o WHERE x IS NOT NULL),
s AS (SELECT a.*, (SELECT max(k) FROM v WHERE v.station = a.station AND v.t_us < a.t_us) AS k1, (SELECT min(k) FROM v WHERE v.station = a.station AND v.t_us >= a.t_us) AS k2 FROM a),
b AS (SELECT s.* EXCLUDE (k1, k2), CASE WHEN late THEN k1 - 1 ELSE k1 END AS k1, CASE WHEN late THEN k1 ELSE k2 END AS k2 FROM (SELECT s.*, s.t_us > tn AND q.t_us = tn AS late FROM s LEFT JOIN v q ON q.station = s.station AND q.k = s.k1) s),
p AS (SELECT b.*, p1.t_us AS t1, p1.x AS x1, p2.t_us AS t2, p2.x AS x2, p0.t_us AS tb, p0.x AS xb, p3.t_us AS ta, p3.x AS xa FROM b LEFT JOIN v p1 ON p1.station = b.station AND p1.k = b.k1
 LEFT JOIN v p2 ON p2.station = b.station AND p2.k = b.k2 LEFT JOIN v p0 ON p0.station = b.station AND p0.k = b.k1 - 1 LEFT JOIN v p3 ON p3.station = b.station AND p3.k = b.k2 + 1),
n AS (SELECT *, t1 >= t_us - {DAY} AS n1, t2 <= CASE WHEN t1 >= t_us - {DAY} THEN t1 ELSE t_us END + {DAY} AS n2, t1 >= t_us - {2 * DAY} AS l1, t2 <= CASE WHEN t1 >= t_us - {2 * DAY} THEN t1 ELSE t_us END + {2 * DAY} AS l2 FROM p),
g AS (SELECT *, greatest(0, coalesce((CASE WHEN coalesce(l2, false) THEN (SELECT max(o.t_us) FROM o WHERE o.station = n.station AND o.t_us < n.t2) ELSE tn END - CASE WHEN coalesce(l1, false) THEN (SELECT min(o.t_us) FROM o WHERE o.station = n.station AND o.t_us > n.t1) ELSE t0 END) / 1e6, 0)) AS gap,
 (SELECT o.x FROM o WHERE o.station = n.station AND o.t_us = (SELECT min(q.t_us) FROM o q WHERE q.station = n.station AND q.t_us >= n.t_us)) AS row_x FROM n),
r AS (SELECT *, CASE WHEN n1 AND n2 AND t_us BETWEEN t0 AND tn THEN CASE WHEN abs((t_us - t1) - (t2 - t_us)) <= 6000000 THEN (x1 + x2) / 2 WHEN t_us - t1 < t2 - t_us THEN x1 ELSE x2 END END AS near,
 CASE WHEN l1 AND l2 THEN x2 + (x2 - x1) * (t_us - t2) / (t2 - t1)::DOUBLE WHEN l1 THEN xb + (xb - x1) * (t_us - tb) / (tb - t1)::DOUBLE WHEN l2 THEN x2 + (x2 - xa) * (t_us - t2) / (t2 - ta)::DOUBLE END AS line FROM g)"""


@query(_GAPS + f"SELECT station, t_us, round(CASE WHEN t2 = t_us THEN x2 WHEN gap <= {DAY // 4 // 1_000_000} THEN coalesce(line, near) ELSE line END, 4) AS x, round(CASE WHEN t2 = t_us THEN x2 WHEN gap <= {DAY // 4 // 1_000_000} THEN near END, 4) AS short FROM r")
def resample_gaps(spark, d):
    """A stack: nearest in gaps of six hours at most, lines with extrapolation in all; beside it the first one alone."""
    hidden = ((F.floor(F.col("t_us") / (DAY // 2)) % 5) != 3) & ~(F.floor(F.col("t_us") / DAY) % 17).isin(4, 5)
    obs = _dense(spark, d).withColumn("x", F.when(hidden, F.col("x")))
    ends = obs.groupBy("station").agg(F.floor(F.min("t_us") / HOUR).alias("a"), F.floor(F.max("t_us") / HOUR).alias("b"))
    asked = ends.select("station", F.explode(F.sequence(F.col("a") - 30, F.col("b") + 30)).alias("k")).select("station", (F.col("k") * HOUR).alias("t_us"))
    near, line = rs.Resample("nearest", 86_400, max_gap=21_600), rs.Resample("linear", 2 * 86_400, extrapolate=True)
    both = rs.resample(obs, asked, "station", "t_us", "x", [near, line])
    short = rs.resample(obs, asked, "station", "t_us", "x", [near]).withColumnRenamed("x", "short")
    return both.join(short, ["station", "t_us"]).select("station", "t_us", R(F.col("x"), "x"), R(F.col("short"), "short"))


_SUMS = f"SELECT event_id, station, t_us, CASE WHEN event_id % 5 = 0 THEN PSUM END AS x, CASE WHEN event_id % 11 <> 0 THEN RH END AS RH, TA, TSS FROM w"


@query(f"""WITH RECURSIVE {WEATHER}, o AS ({_SUMS}), p AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY t_us) - 1 AS i, t_us - lag(t_us) OVER (PARTITION BY station ORDER BY t_us) AS dur FROM o),
c AS (SELECT *, (SELECT min(q.i) FROM p q WHERE q.station = p.station AND q.i > p.i AND q.x IS NOT NULL) AS valid, (SELECT min(q.i) FROM p q WHERE q.station = p.station AND q.t_us > p.t_us + {7 * DAY}) AS far FROM p),
e AS (SELECT *, CASE WHEN valid IS NOT NULL AND (far IS NULL OR valid < far) THEN valid ELSE far - 1 END AS e FROM c),
r AS (SELECT station, i, e FROM e WHERE i = 0 UNION ALL SELECT n.station, n.i, n.e FROM r JOIN e n ON n.station = r.station AND n.i = CASE WHEN r.e = r.i THEN r.i + 1 ELSE r.e END WHERE r.e IS NOT NULL),
k AS (SELECT r.station, p.i, p.event_id, v.x AS total, p.dur, (p.RH >= 0.7 AND p.RH IS NOT NULL)::INT + (p.TA - p.TSS <= 3)::INT AS score, r.i AS a FROM r JOIN p ON p.station = r.station AND p.i > r.i AND p.i <= coalesce(r.e, p.i) LEFT JOIN p v ON v.station = r.station AND v.i = r.e WHERE r.e IS NULL OR r.e > r.i),
m AS (SELECT *, max(score) OVER (PARTITION BY station, a) AS best FROM k), d AS (SELECT *, sum(CASE WHEN score = best THEN dur END) OVER (PARTITION BY station, a) AS win FROM m)
SELECT p.event_id, round(CASE WHEN z.i IS NOT NULL THEN 0 WHEN d.i IS NULL THEN p.x WHEN total IS NULL OR score < best THEN 0 ELSE total * d.dur / win END, 4) AS x FROM p LEFT JOIN d USING (station, i) LEFT JOIN (SELECT station, i FROM r WHERE e = i) z USING (station, i)""")
def filter_psum_distribute(spark, d):
    """PSUM_DISTRIBUTE over a week."""
    w = weather(spark, d).withColumns({"x": F.when(F.col("event_id") % 5 == 0, F.col("PSUM")), "RH": F.when(F.col("event_id") % 11 != 0, F.col("RH"))})
    return co.distribute_sums(w, "station", "t_us", "x", "RH", "TA", "TSS", 7 * 86_400).select("event_id", R(F.col("x"), "x"))


@query(f"""WITH {OBS}, s AS (SELECT event_id, station, x / 60 AS x FROM obs), l AS (SELECT station, quantile_cont(coalesce(x, 0), [0, 0.25, 0.5, 0.8, 0.9]) AS l FROM s GROUP BY station),
k AS (SELECT event_id, x, l, len(list_filter(l, lambda v: v < x)) + 1 AS k FROM s JOIN l USING (station)),
f AS (SELECT event_id, x, coalesce([1.2, 1.1, 1.05, 0.95, 0.89][CASE WHEN k > 5 THEN NULL WHEN l[k] < 0.5 THEN k WHEN k > 1 THEN k - 1 END], 1.0) AS f FROM k) SELECT event_id, round(x * f, 8) AS times, round(x + f, 8) AS plus FROM f""")
def filter_quantile_mapping(spark, d):
    """QM, multiplied and added, on each station's whole series."""
    obs = observations(spark, d).withColumn("x", F.col("x") / 60)
    args = ("station", "x", [0.0, 0.25, 0.5, 0.8, 0.9], [1.2, 1.1, 1.05, 0.95, 0.89])
    plus = co.quantile_map(obs, *args, multiply=False).select("event_id", R8(F.col("x"), "plus"))
    return co.quantile_map(obs, *args).select("event_id", R8(F.col("x"), "times")).join(plus, "event_id")


_CLEAR = """s AS (SELECT *, (event_id * 53) % 1100 / 10.0::DOUBLE - 20 AS el, ((event_id * 59) % 360)::DOUBLE AS az, ((event_id * 7) % 9) / 10.0::DOUBLE AS alb, ((event_id * 3) % 900)::DOUBLE AS iswr, ((event_id * 17) % 360)::DOUBLE AS saz, ((event_id * 5) % 60)::DOUBLE AS sel, 1 + 0.033 * cos(radians(event_id % 360)) AS ecc FROM w),
a AS (SELECT *, cos(radians(90 - el)) AS cz, 1366.1 * ecc AS toa, 101325 * pow(1 - 0.0065 * 6356766 * ALT / (288.15 * (6356766 + ALT)), 9.80665 / (0.0065 * 287.058)) AS p, 611.73 * exp(CASE WHEN TA < 273.16 THEN 21.88 * (TA - 273.16) / (TA - 7.66) ELSE 17.27 * (TA - 273.16) / (TA - 35.86) END) AS ps FROM s),
b AS (SELECT *, (1.002432 * cz * cz + 0.148386 * cz + 0.0096467) / (cz ^ 3 + 0.149864 * cz ^ 2 + 0.0102963 * cz + 0.000303978) AS mr FROM a WHERE el >= 0),
c AS (SELECT *, mr * p / 101325 AS ma, 0.32 * mr AS u3, 0.493 * RH * ps / TA * mr AS u1, 0.2758 * 0.03 * pow(0.38, -1.3) + 0.35 * 0.03 * pow(0.5, -1.3) AS ka FROM b),
d AS (SELECT *, exp(-0.0903 * pow(ma, 0.84) * (1 + ma - pow(ma, 1.01))) AS taur, 1 - 0.1611 * u3 * pow(1 + 139.48 * u3, -0.3035) + 0.002715 * u3 / (1 + 0.044 * u3 + 0.0003 * u3 * u3) AS tauo, exp(-0.0127 * pow(ma, 0.26)) AS taug,
 1 - 2.4959 * u1 / (pow(1 + 79.034 * u1, 0.6828) + 6.385 * u1) AS tauw, exp(-pow(ka, 0.873) * (1 + ka - pow(ka, 0.7088)) * pow(ma, 0.9108)) AS taua FROM c),
e AS (SELECT *, taua / (1 - 0.1 * (1 - ma + pow(ma, 1.06)) * (1 - taua)) AS taus, tauo * taug * tauw * taua AS tau FROM d),
f AS (SELECT *, 0.79 * toa * tau / (1 - ma + pow(ma, 1.02)) AS k, 0.9751 * (taur * tau + 2.2e-5 * least(ALT, 3000)) * toa AS dir, 0.0685 + 0.16 * (1 - taus) AS sky FROM e),
g AS (SELECT *, k * 0.5 * (1 - taur) + k * 0.84 * (1 - taus) AS once FROM f),
h AS (SELECT *, (once + (once + dir) * alb * sky / (1 - alb * sky)) * cz AS dif FROM g)"""


@query(f"""WITH {WEATHER}, {_CLEAR}, i AS (SELECT s.event_id, s.el, s.az, s.saz, s.sel, s.iswr, CASE WHEN s.el < 0 THEN 0 WHEN s.el < 5 THEN 0 ELSE dir END AS beam, CASE WHEN s.el < 0 THEN 0 WHEN s.el < 5 THEN dif + dir * cz ELSE dif END AS diffuse, CASE WHEN s.el < 0 THEN 0 ELSE 1366.1 * s.ecc * cos(radians(90 - s.el)) END AS toa_h FROM s LEFT JOIN h USING (event_id))
SELECT event_id, round(beam, 6) AS beam, round(diffuse, 6) AS diffuse, round(beam * cos(radians(90 - el)), 6) AS horizontal, round(greatest(0, beam * (cos(radians(sel)) * cos(radians(90 - el)) + sin(radians(sel)) * sin(radians(90 - el)) * cos(radians(az - saz)))), 6) AS slope,
 round(CASE WHEN el < 5 THEN 1 WHEN iswr / toa_h >= 0.78 THEN 0.147 WHEN iswr / toa_h <= 0.3 THEN least(1, 1.02 - 0.248 * iswr / toa_h) ELSE greatest(0.147, least(0.97, 1.4 - 1.749 * iswr / toa_h + 0.177 * sin(radians(el)))) END, 6) AS splitting FROM i""")
def radiation_clear_sky(spark, d):
    """Direct and diffuse clear-sky radiation, on the horizontal and a slope, and the diffuse share of measured radiation."""
    i = F.col("event_id")
    w = weather(spark, d)
    el, ecc = (i * 53) % 1100 / 10.0 - 20, 1 + 0.033 * F.cos(F.radians((i % 360).cast("double")))
    toa = F.when(el >= 0, ra.SOLAR_CONSTANT * ecc).otherwise(0.0)
    sky = ra.clear_sky(el, toa, F.col("TA"), F.col("RH"), air.std_pressure(F.col("ALT")), (i * 7) % 9 / 10.0, F.col("ALT"))
    w = w.select("event_id", el.alias("el"), ((i * 59) % 360).cast("double").alias("az"), ra.on_horizontal(toa, el).alias("toa_h"), sky.alias("sky"))
    beam = F.col("sky.direct")
    r6 = lambda c, name: F.round(c, 6).alias(name)
    slope = ra.on_slope(beam, F.col("el"), F.col("az"), ((i * 5) % 60).cast("double"), ((i * 17) % 360).cast("double"))
    return w.select("event_id", r6(beam, "beam"), r6(F.col("sky.diffuse"), "diffuse"), r6(ra.on_horizontal(beam, F.col("el")), "horizontal"), r6(slope, "slope"), r6(ra.diffuse_share(((i * 3) % 900).cast("double"), F.col("toa_h"), F.col("el")), "splitting"))


_RAYS = """WITH z AS (SELECT p_partkey % 40 AS i, p_partkey // 40 AS j, CASE WHEN p_partkey % 97 <> 96 THEN p_retailprice::DOUBLE END AS z FROM part),
e AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, greatest((max(z) - min(z)) / tan(radians(5)) / 100, 1.5) AS reach FROM z)"""


@query(_RAYS + """, b AS (SELECT unnest([0, 45, 100, 200, 315]) AS b), s AS (SELECT b, k, round(k * sin(radians(b)))::BIGINT AS x, round(k * cos(radians(b)))::BIGINT AS y FROM b, (SELECT unnest(generate_series(2, 400)) AS k)),
l AS (SELECT *, sqrt(x * x + y * y) AS far FROM s), u AS (SELECT l.* FROM l, e WHERE k <= (SELECT min(m.k) FROM l m, e f WHERE m.b = l.b AND m.far > f.reach)),
r AS (SELECT z.i, z.j, z.z, u.b, u.k, (n.z - z.z) / (far * 100) AS t, n.z IS NULL OR n.i <= i0 OR n.i >= i1 OR n.j <= j0 OR n.j >= j1 AS over FROM z, e, u LEFT JOIN z n ON n.i = z.i + u.x AND n.j = z.j + u.y WHERE z.z IS NOT NULL AND z.i > i0 AND z.i < i1 AND z.j > j0 AND z.j < j1),
f AS (SELECT *, bool_or(over) OVER (PARTITION BY i, j, b ORDER BY k) AS gone FROM r), m AS (SELECT i, j, b, greatest(0, coalesce(max(t) FILTER (NOT gone), 0)) AS h FROM f GROUP BY ALL)
SELECT z.i, z.j, b.b::DOUBLE AS bearing, round(CASE WHEN z.z IS NOT NULL THEN coalesce(m.h, 0) END, 6) AS horizon FROM z CROSS JOIN b LEFT JOIN m ON m.i = z.i AND m.j = z.j AND m.b = b.b""")
def terrain_horizon(spark, d):
    """Tangents of the horizon in five directions, in tiles of 16 cells."""
    return ho.horizon(elevations(spark, d), 100.0, [0.0, 45.0, 100.0, 200.0, 315.0], tile=16).select("i", "j", "bearing", F.round("horizon", 6).alias("horizon"))


@query(_RAYS + """, s AS (SELECT b, k, round(k * sin(radians(b * 11.25)))::BIGINT AS x, round(k * cos(radians(b * 11.25)))::BIGINT AS y FROM (SELECT unnest(generate_series(0, 31)) AS b), (SELECT unnest(generate_series(1, 16)) AS k)),
r AS (SELECT z.i, z.j, s.b, max((n.z - z.z) / (100 * sqrt(x * x + y * y))) AS t FROM z CROSS JOIN s LEFT JOIN z n ON n.i = z.i + s.x AND n.j = z.j + s.y AND x * x + y * y <= 144 WHERE z.z IS NOT NULL GROUP BY ALL),
v AS (SELECT i, j, pow(cos(greatest(0, atan(coalesce(t, -99999)) + atan(tan(radians((i * 7 + j * 3) % 40)) * cos(radians(b * 11.25 - (i * 31 + j * 17) % 360))))), 2) AS v FROM r)
SELECT z.i, z.j, round(avg(v.v), 6) AS sky FROM z LEFT JOIN v ON v.i = z.i AND v.j = z.j GROUP BY ALL""")
def terrain_sky_view(spark, d):
    """Sky view of inclined cells, over 1,200 metres."""
    i, j = F.col("i"), F.col("j")
    cells_ = elevations(spark, d).withColumns({"slope": ((i * 7 + j * 3) % 40).cast("double"), "azimuth": ((i * 31 + j * 17) % 360).cast("double")})
    return ho.sky_view(cells_, 100.0, 1200.0, 16).select("i", "j", F.round("sky", 6).alias("sky"))


_SUN = ORACLES["solar_position"].split("SELECT event_id, round(degrees(decl)")[0]
_SKY = "a AS" + _CLEAR.split("),\na AS", 1)[1]


@query(f"""WITH {WEATHER}, pos AS ({_SUN} SELECT event_id, el, e FROM i), s AS (SELECT w.* EXCLUDE (TA, RH), el, 1 + e AS ecc, CASE WHEN w.event_id % 13 = 0 THEN 274.98 ELSE TA END AS TA, CASE WHEN w.event_id % 13 = 0 THEN 0.666 ELSE RH END AS RH,
 CASE WHEN w.event_id % 3 = 0 THEN 0.5 WHEN w.event_id % 4 >= 1 THEN 0.85 ELSE 0.23 END AS alb, CASE WHEN w.event_id % 13 <> 0 THEN 150 + (w.event_id * 3) % 250 END AS ilwr, CASE WHEN w.event_id % 5 = 0 THEN (w.event_id % 100) / 100 END AS trans, ((w.event_id * 7) % 700)::DOUBLE AS rswr FROM w JOIN pos USING (event_id)), {_SKY},
t AS (SELECT s.event_id, s.alb, s.rswr, s.trans, s.ilwr, CASE WHEN s.el < 0 THEN 0 ELSE 1366.1 * s.ecc * sin(radians(s.el)) END AS top, CASE WHEN s.el < 0 THEN 0 ELSE dir * cz + dif END AS ground, 5.670373e-8 * pow(s.TA, 4) AS bb,
 (59.38 + 113.7 * pow(s.TA / 273.16, 6) + 96.96 * sqrt(4.65 * s.RH * 611.73 * exp(CASE WHEN s.TA < 273.16 THEN 21.88 * (s.TA - 273.16) / (s.TA - 7.66) ELSE 17.27 * (s.TA - 273.16) / (s.TA - 35.86) END) / s.TA / 25)) / (5.670373e-8 * pow(s.TA, 4)) AS em FROM s LEFT JOIN h USING (event_id)),
u AS (SELECT *, coalesce(trans, CASE WHEN ilwr IS NOT NULL THEN 1 - 0.75 * pow(greatest(0, least(1, (ilwr / bb - em) / (0.84 * (1 - em)))), 3.4) END, 1) AS idx FROM t)
SELECT event_id, round(ground, 4) AS clear, round(ground * alb, 4) AS reflected, round(ground * idx, 4) AS all_sky, round(CASE WHEN rswr / alb >= 0.03 * top AND rswr / alb >= 0.03 * ground AND rswr / alb <= 1.1 * ground THEN rswr END, 4) AS kept,
 round(CASE WHEN rswr / alb < 0.03 * ground THEN 0.03 * ground * alb WHEN rswr / alb > 1.1 * ground THEN 1.1 * ground * alb ELSE rswr END, 4) AS held FROM u""")
def generator_shortwave(spark, d):
    """CLEARSKY_SW, ALLSKY_SW and the potential filter (hard, and soft at the ground) on reflected radiation."""
    i = F.col("event_id")
    dry = i % 13 != 0
    w = weather(spark, d).withColumns({"TA": F.when(dry, F.col("TA")), "RH": F.when(dry, F.col("RH")), "hs": F.when(i % 3 != 0, (i % 4) / 10.0), "ilwr": F.when(dry, 150.0 + i * 3 % 250), "tau": F.when(i % 5 == 0, i % 100 / 100.0), "rswr": (i * 7 % 700).cast("double")})
    none = F.lit(None).cast("double")
    w = w.withColumn("alb", sw.ground_albedo(none, none, F.col("hs")))
    place = sw.Place(F.col("LAT"), i * 17 % 360 - 180, F.col("ALT"))
    w = sw.with_potential(w, "sky", F.col("t_us"), place, F.col("TA"), F.col("RH"), None, F.col("alb"))
    ground, x = F.col("sky.ground"), F.col("rswr")
    index = sw.all_sky_index(F.col("TA"), F.col("RH"), F.col("ilwr"), F.col("tau"))
    hard = sw.potential_filter(x, F.col("sky"), albedo=F.col("alb"))
    soft = sw.potential_filter(x, F.col("sky"), soft=True, ground=True, albedo=F.col("alb"))
    return w.select("event_id", R(ground, "clear"), R(ground * F.col("alb"), "reflected"), R(ground * index, "all_sky"), R(hard, "kept"), R(soft, "held"))


@query()
def resample_solar(spark, d):
    """SOLAR: a share of the potential radiation at the events' times, resampled to hours."""
    obs = _dense(spark, d)
    places = obs.select("station").distinct().withColumns({"lat": F.lit(46.8), "lon": F.lit(9.8), "alt": F.lit(1560.0)})
    pot = sw.with_potential(obs.join(places, "station"), "pot", F.col("t_us"), sw.Place(F.col("lat"), F.col("lon"), F.col("alt")))
    radiation = pot.select("station", "t_us", (F.col("pot.ground") * F.col("x") / 100).alias("x"))
    out = sw.resample_solar(radiation, se.grid_of(obs, "station", "t_us", HOUR), "station", "t_us", "x", places)
    return out.select("station", "t_us", R(F.col("x"), "x"))


_KRIGED = """pr AS (SELECT a.region, hypot AS d, (a.value - b.value) * (a.value - b.value) / hypot AS v FROM sk a JOIN sk b ON a.region = b.region AND a.station < b.station, LATERAL (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS hypot)),
bn AS (SELECT *, count(*) OVER (PARTITION BY region) AS n, row_number() OVER (PARTITION BY region ORDER BY d, v) AS one, ntile(10) OVER (PARTITION BY region ORDER BY d, v) AS tenth FROM pr),
pt AS (SELECT region, avg(d) AS d, avg(v) AS v FROM bn GROUP BY region, CASE WHEN n > 40 THEN tenth ELSE one END),
va AS (SELECT region, regr_slope(v, d) AS s, regr_intercept(v, d) AS c FROM pt GROUP BY region HAVING count(*) >= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY station) AS i, count(*) OVER (PARTITION BY region) AS n FROM sk),
rw AS (SELECT a.region, a.i, any_value(a.n) AS n, list(CASE WHEN a.i = b.i THEN 1 ELSE c + s * sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) END ORDER BY b.i) || [1.0::DOUBLE, any_value(a.value)] AS r FROM o a JOIN o b USING (region) JOIN va USING (region) GROUP BY a.region, a.i),
mt AS (SELECT region, any_value(n) + 1 AS n, list(r ORDER BY i) || [list_transform(range(any_value(n)), lambda u: 1.0::DOUBLE) || [0.0::DOUBLE, 0.0::DOUBLE]] AS m FROM rw GROUP BY region),
g AS (SELECT region, 1 AS k, n, m FROM mt UNION ALL
 SELECT region, k + 1, n, list_transform(w, lambda r, i: CASE WHEN i = k THEN q ELSE list_transform(r, lambda u, j: u - r[k] * q[j]) END) FROM (SELECT *, list_transform(w[k], lambda u: u / w[k][k]) AS q FROM (
  SELECT region, k, n, list_transform(m, lambda r, i: CASE WHEN i = k THEN m[p] WHEN i = p THEN m[k] ELSE r END) AS w FROM (SELECT *, k - 1 + list_position(l, list_max(l)) AS p FROM (SELECT *, list_transform(m[k:], lambda r: abs(r[k])) AS l FROM g WHERE k <= n)))))
, so AS (SELECT region, n, list_transform(m, lambda r: r[n + 1]) AS w FROM g WHERE k = n + 1),
kr AS (SELECT ck.region, ck.cell, any_value(ck.alt) AS alt, any_value(so.w[so.n]) + sum(CASE WHEN d = 0 THEN 0 ELSE (va.c + va.s * d) * so.w[o.i] END) AS value FROM ck JOIN o USING (region) JOIN so USING (region) JOIN va USING (region), LATERAL (SELECT sqrt((ck.x - o.x) * (ck.x - o.x) + (ck.y - o.y) * (ck.y - o.y)) AS d) GROUP BY ALL)"""
_BLOCKS = "s0 AS (SELECT * REPLACE (station // 40 AS region) FROM st), ck AS (SELECT * REPLACE (cell // 600 AS region) FROM ce)"


def _blocks(spark, d):
    """Regions of forty stations and of the cells beside them, so their number grows and not their size."""
    by = lambda c, n: F.floor(F.col(c) / n).cast("long")
    return cells(spark, d).withColumn("region", by("cell", 600)), stations(spark, d).withColumn("region", by("station", 40))


@query(f"WITH RECURSIVE {STATIONS}, {CELLS}, {_BLOCKS}, sk AS (SELECT * FROM s0), {_KRIGED} SELECT ck.region, ck.cell, round(kr.value, 4) AS value FROM ck LEFT JOIN kr USING (region, cell)")
def spatial_kriging(spark, d):
    """ODKRIG with a linear variogram over equal-count bins of pairs."""
    return kg.kriging(*_blocks(spark, d)).select("region", "cell", R(F.col("value"), "value"))


@query(f"""WITH RECURSIVE {STATIONS}, {CELLS}, {_BLOCKS}, tr AS (SELECT region, coalesce(regr_slope(value, alt), 0) AS sl, avg(value) - coalesce(regr_slope(value, alt), 0) * avg(alt) AS ic FROM s0 GROUP BY region),
sk AS (SELECT s0.* REPLACE (value - sl * alt - ic AS value) FROM s0 JOIN tr USING (region)), {_KRIGED} SELECT ck.region, ck.cell, round(kr.value + sl * ck.alt + ic, 4) AS value FROM ck LEFT JOIN kr USING (region, cell) LEFT JOIN tr ON tr.region = ck.region""")
def spatial_kriging_lapse(spark, d):
    """ODKRIG_LAPSE: kriging around the altitude trend of each region."""
    return kg.kriging_lapse(*_blocks(spark, d)).select("region", "cell", R(F.col("value"), "value"))


@query(f"""WITH {WEATHER}, p AS (SELECT *, CASE WHEN event_id % 9 <> 0 THEN VW END AS v, make_timestamp(t_us) AS ts FROM w)
SELECT event_id, round(CASE WHEN v IS NULL THEN NULL WHEN TA < 273.15 OR ends_with(CAST(station AS VARCHAR), '7') THEN v * (1 + 0.1 * pow(sin(2 * pi() * (t_us / 86400000000 + 2440587.5) / 365.25), 2)) + 4 ELSE sqrt(v) / (DW + 1) END, 4) AS wind,
 round(CASE WHEN v IS NULL AND month(ts) >= 2 AND ALT <> 0 THEN fmod(ALT, 7) + hour(ts) * 60 + minute(ts) ELSE RH END, 4) AS rh, CASE WHEN CLD = 0.5 THEN NULL ELSE round(atan2(TA, TSS) * 101325, 4) END AS psum, PSUM AS before FROM p""")
def filter_maths_conditions(spark, d):
    """MATHS with OR and AND, texts, parts of the time, a missing value in a comparison, an else branch and an assigned parameter."""
    w = weather(spark, d).withColumn("VW", F.when(F.col("event_id") % 9 != 0, F.col("VW")))
    cold = [fm.Condition("meteo(TA)", "LT", "stdtemp - 15"), fm.Condition("stationid", "STREND", "7")]
    w = fm.maths(w, "VW", "meteo(VW) * (1 + 0.1*sin(2*pi*julian/365.25)^2) - -2^2 + 8", "sqrt meteo(VW) / (meteo(DW) + 1)", cold, "OR", "WIND", True, time="t_us", station="station")
    missing = [fm.Condition("meteo(VW)", "EQ", "nodata"), fm.Condition("month", "GE", "2"), fm.Condition("altitude", "NE", "0")]
    w = fm.maths(w, "RH", "altitude % 7 + hour * 60 + minute", None, missing, time="t_us", place={"altitude": "ALT"})
    w = fm.maths(w, "PSUM", "nodata", "atan2(meteo(TA), meteo(TSS)) * stdpress", [fm.Condition("meteo(CLD)", "EQ", "0.5")], assign="NEW")
    return w.select("event_id", R(F.col("WIND"), "wind"), R(F.col("RH"), "rh"), R(F.col("NEW"), "psum"), F.col("PSUM").alias("before"))


def _resized(factor: float, values: str) -> str:
    """Grids of ``factor`` times the cells; ``values`` is over ``t`` with the origin a, b, the parts x, y and the grid ``dem``."""
    return f"""WITH {ELEVATIONS}, n AS (SELECT max(i) + 1 AS nx, max(j) + 1 AS ny FROM dem), m AS (SELECT *, floor(nx * {factor} + 0.5)::BIGINT AS mx, floor(ny * {factor} + 0.5)::BIGINT AS my FROM n),
s AS (SELECT i, j, i / (mx / nx) AS px, j / (my / ny) AS py, nx, ny FROM m, (SELECT unnest(range((SELECT mx FROM m))) AS i), (SELECT unnest(range((SELECT my FROM m))) AS j)),
t AS (SELECT *, floor(px)::BIGINT AS a, floor(py)::BIGINT AS b, px - floor(px) AS x, py - floor(py) AS y FROM s), full_ AS (SELECT g.i, g.j, value FROM (SELECT DISTINCT i, j FROM dem) g LEFT JOIN dem USING (i, j)),
q AS (SELECT t.i, t.j, any_value(a >= nx - 1 OR b >= ny - 1) AS edge, max(value) FILTER (f.i = a AND f.j = b) AS own, count(value) FILTER (f.i BETWEEN a AND a + 1 AND f.j BETWEEN b AND b + 1) AS four, avg(value) FILTER (f.i BETWEEN a AND a + 1 AND f.j BETWEEN b AND b + 1) AS mean,
 sum((1 - abs(f.i - px)) * (1 - abs(f.j - py)) * value) FILTER (f.i BETWEEN a AND a + 1 AND f.j BETWEEN b AND b + 1) AS part, sum((1 - abs(f.i - px)) * (1 - abs(f.j - py))) FILTER (value IS NOT NULL AND f.i BETWEEN a AND a + 1 AND f.j BETWEEN b AND b + 1) AS share,
 count(value) AS sixteen, min(value) AS lo, max(value) AS hi, sum(value * CASE WHEN abs(f.i - px) < 1 THEN 2 / 3 - pow(f.i - px, 2) + pow(abs(f.i - px), 3) / 2 ELSE pow(2 - abs(f.i - px), 3) / 6 END * CASE WHEN abs(f.j - py) < 1 THEN 2 / 3 - pow(f.j - py, 2) + pow(abs(f.j - py), 3) / 2 ELSE pow(2 - abs(f.j - py), 3) / 6 END) AS spline
 FROM t JOIN full_ f ON f.i BETWEEN a - 1 AND a + 2 AND f.j BETWEEN b - 1 AND b + 2 GROUP BY t.i, t.j)
SELECT i, j, round({values}, 4) AS value FROM q"""


_FOUR = "CASE WHEN edge THEN own WHEN four >= 3 THEN part + (1 - share) * mean END"


@query(_resized(1.7, "own"))
def grid_nearest(spark, d):
    """The elevations on a finer grid, by nearest cells."""
    return rg.resize(elevations(spark, d), 1.7, "NEAREST").select("i", "j", R(F.col("value"), "value"))


@query(_resized(2.5, _FOUR))
def grid_bilinear(spark, d):
    """The elevations on a finer grid, bilinear."""
    return rg.resize(elevations(spark, d), 2.5, "BILINEAR").select("i", "j", R(F.col("value"), "value"))


@query(_resized(0.6, _FOUR))
def grid_coarser(spark, d):
    """The elevations on a coarser grid, bilinear."""
    return rg.resize(elevations(spark, d), 0.6, "BILINEAR").select("i", "j", R(F.col("value"), "value"))


@query(_resized(3.0, f"CASE WHEN sixteen = 16 THEN greatest(lo, least(hi, spline)) WHEN sixteen > 0 THEN {_FOUR} END"))
def grid_spline(spark, d):
    """The elevations on a finer grid, by cubic B-splines."""
    return rg.resize(elevations(spark, d), 3.0, "BSPLINE").select("i", "j", R(F.col("value"), "value"))


@query()
def filter_despiking(spark, d):
    """DESPIKING by both methods: spikes that go missing, and spikes replaced by cubic polynomials."""
    obs = _dense(spark, d)
    gone = ds.despike(obs, "station", "t_us", "x", sensitivity=0.6, degree=0).withColumnRenamed("x", "gone")
    fitted = ds.despike(obs, "station", "t_us", "x", "MORI", 0.6).withColumnRenamed("x", "fitted")
    return gone.join(fitted, ["station", "t_us"]).select("station", "t_us", R(F.col("gone"), "gone"), R(F.col("fitted"), "fitted"))
