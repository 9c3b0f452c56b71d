"""SMET text files of stations: header lines up to [DATA], then columns named by ``fields``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_smet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Long rows (station_id, ts in UTC, param, value) of all files; nodata is null, units are SI.

    A file is one row while it is parsed; files of a station are of bounded length. All of it is DataFrame functions.
    """
    raw = spark.read.text(paths, wholetext=True).select(F.split("value", r"\[DATA\]\r?\n", 2).alias("p"))
    head = F.transform(F.filter(F.split(F.col("p")[0], r"\r?\n"), lambda l: F.instr(l, "=") > 0), lambda l: F.struct(F.lower(F.trim(F.substring_index(l, "=", 1))).alias("key"), F.trim(F.substring(l, F.instr(l, "=") + 1, F.length(l))).alias("val")))
    files = raw.select(F.map_from_entries(head).alias("h"), F.explode(F.split(F.col("p")[1], r"\r?\n")).alias("line")).where(F.length(F.trim("line")) > 0)
    names = F.split(F.col("h")["fields"], r"\s+")
    scale = lambda key, default: F.coalesce(F.get(F.split(F.col("h")[key], r"\s+"), F.col("i")).cast("double"), F.lit(default))
    cell = files.select("h", F.split(F.trim("line"), r"\s+").alias("v"), names.alias("names")).select("h", F.col("v")[0].alias("time"), F.posexplode(F.arrays_zip("names", "v")).alias("i", "c"))
    value = F.col("c.v").try_cast("double")
    known = F.when(value != F.coalesce(F.col("h")["nodata"].cast("double"), F.lit(-999.0)), value)
    ts = F.to_timestamp(F.regexp_replace("time", "T", " ")) - F.make_dt_interval(secs=F.coalesce(F.col("h")["tz"].cast("double"), F.lit(0.0)) * 3600)
    out = cell.where(F.lower("c.names") != "timestamp")
    return out.select(F.col("h")["station_id"].alias("station_id"), ts.alias("ts"), F.col("c.names").alias("param"), (known * scale("units_multiplier", 1.0) + scale("units_offset", 0.0)).alias("value"))


def write_smet(long: DataFrame, path: str, params: list[str], nodata: float = -999.0) -> None:
    """One folder of text a station, rows in time order below a header."""
    wide = long.groupBy("station_id", "ts").pivot("param", params).agg(F.first("value"))
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), *(F.coalesce(F.col(p), F.lit(nodata)).cast("string") for p in params))
    rows = wide.select("station_id", F.lit(1).alias("part"), "ts", line.alias("value"))
    head = F.concat(F.lit("SMET 1.1 ASCII\n[HEADER]\nstation_id = "), F.col("station_id"), F.lit(f"\nnodata = {nodata:g}\ntz = 0\nfields = timestamp {' '.join(params)}\n[DATA]"))
    heads = wide.select("station_id").distinct().select("station_id", F.lit(0).alias("part"), F.lit(None).cast("timestamp").alias("ts"), head.alias("value"))
    both = heads.unionByName(rows).repartition("station_id").sortWithinPartitions("station_id", "part", "ts")
    both.select("station_id", "value").write.partitionBy("station_id").text(path)
