"""Observations and stations derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, station, t_us, x): events as series of their users; every seventh value is missing."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", F.col("user_id").alias("station"), t.alias("t_us"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"))


OBS = "obs AS (SELECT event_id, user_id AS station, epoch_us(ts) AS t_us, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events)"


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several parameters of each event, in the ranges of real weather."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    part = lambda k, n: (i * k) % n
    return e.select(
        "event_id", F.col("user_id").alias("station"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        (part(37, 7000) / 100.0 + 243.15).alias("TA"), ((part(13, 96) + 4) / 100.0).alias("RH"), (part(7, 150) / 10.0).alias("VW"), part(19, 360).cast("double").alias("DW"),
        (part(11, 40) / 10.0).alias("PSUM"), (part(41, 7000) / 100.0 + 240.15).alias("TSS"), (part(29, 101) / 100.0).alias("CLD"), (part(97, 3000)).cast("double").alias("ALT"), (part(31, 900) / 10.0 - 45).alias("LAT"),
    )


WEATHER = """w AS (SELECT event_id, user_id AS station, epoch_us(ts) AS t_us, ((event_id*37)%7000)/100.0::DOUBLE + 243.15 AS TA, (((event_id*13)%96)+4)/100.0::DOUBLE AS RH,
 ((event_id*7)%150)/10.0::DOUBLE AS VW, ((event_id*19)%360)::DOUBLE AS DW, ((event_id*11)%40)/10.0::DOUBLE AS PSUM, ((event_id*41)%7000)/100.0::DOUBLE + 240.15 AS TSS,
 ((event_id*29)%101)/100.0::DOUBLE AS CLD, ((event_id*97)%3000)::DOUBLE AS ALT, ((event_id*31)%900)/10.0::DOUBLE - 45 AS LAT FROM events)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations of their nation, on a 100 km square."""
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("region"), k.alias("station"), ((k * 7919) % 100_000).cast("double").alias("x"), ((k * 104_729) % 100_000).cast("double").alias("y"), ((k * 1237) % 3000).cast("double").alias("alt"), F.col("s_acctbal").cast("double").alias("value"))


STATIONS = "st AS (SELECT s_nationkey AS region, s_suppkey AS station, ((s_suppkey*7919)%100000)::DOUBLE AS x, ((s_suppkey*104729)%100000)::DOUBLE AS y, ((s_suppkey*1237)%3000)::DOUBLE AS alt, s_acctbal::DOUBLE AS value FROM supplier)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as grid cells of their nation."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("region"), k.alias("cell"), ((k * 31) % 100_000).cast("double").alias("x"), ((k * 57) % 100_000).cast("double").alias("y"), ((k * 11) % 3000).cast("double").alias("alt"))


CELLS = "ce AS (SELECT c_nationkey AS region, c_custkey AS cell, ((c_custkey*31)%100000)::DOUBLE AS x, ((c_custkey*57)%100000)::DOUBLE AS y, ((c_custkey*11)%3000)::DOUBLE AS alt FROM customer)"


def elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a grid of 40 columns: (grid, i, j, value), every 97th value missing."""
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit(1).alias("grid"), (k % 40).alias("i"), F.floor(k / 40).cast("long").alias("j"), F.when(k % 97 != 96, F.col("p_retailprice")).alias("value"))


ELEVATIONS = "dem AS (SELECT p_partkey % 40 AS i, p_partkey // 40 AS j, CASE WHEN p_partkey % 97 <> 96 THEN p_retailprice END AS value FROM part)"
