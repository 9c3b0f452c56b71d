"""CSV files of stations with a header: long rows (station_id, ts in UTC, param, value) in SI units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, paths: str | list[str], params: dict[str, str], time: str, time_format: str, station: str | None = None, station_id: str | None = None, delimiter: str = ",", nodata: float = -999.0, tz: float = 0.0, multiplier: dict[str, float] | None = None, offset: dict[str, float] | None = None) -> DataFrame:
    """``params`` names the parameter of each column; ``station`` is the column of the station, ``station_id`` stands in for it.

    ``nodata`` and what is no number are null; multipliers and offsets go by parameter, multipliers first.
    """
    raw = spark.read.csv(paths, header=True, sep=delimiter, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    name = F.col(f"`{station}`") if station else F.lit(station_id)
    ts = F.try_to_timestamp(F.col(f"`{time}`"), F.lit(time_format)) - F.make_dt_interval(secs=F.lit(tz * 3600))
    known = lambda c: F.when(F.col(f"`{c}`").try_cast("double") != nodata, F.col(f"`{c}`").try_cast("double"))
    value = {p: known(c) * (multiplier or {}).get(p, 1.0) + (offset or {}).get(p, 0.0) for c, p in params.items()}
    wide = raw.select(name.alias("station_id"), ts.alias("ts"), *(v.alias(p) for p, v in value.items()))
    return wide.unpivot(["station_id", "ts"], list(value), "param", "value")
