"""Series as runs of consecutive rows, each packed into one row, so that a task holds a few runs and never a series.

A series is cut into equal parts of its own time, as many as half runs are in it; rows are counted in each part and numbered from the
counts, and a part with more than RUN rows is cut by these numbers. Times and values of a run are bytes, in the order of time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a run at most.
RUN = 65_536


def met(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join by ``keys``, where null meets null."""
    named = right.select(*(F.col(c).alias(f"{c}__") if c in keys else F.col(c) for c in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    return left.join(named, on, how).drop(*(f"{k}__" for k in keys))


def numbered(rows: DataFrame, station: str, time: str, value: str, block_us: int | None = None) -> DataFrame:
    """(s, t, v, lo, hi, size, block, before, n): rows numbered from 0 in the order of time, ``before`` of them before their part ``block`` of the series.

    The series lasts from ``lo`` to ``hi`` and has ``size`` rows. Parts are ``block_us`` long if that is given. Times of a series are distinct.
    """
    keyed = rows.select(F.col(station).alias("s"), F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("v"))
    ends = keyed.groupBy("s").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("t").alias("size")).where("lo IS NOT NULL")
    part = F.expr(f"(hi - lo) div (2 * size div {RUN} + 1) + 1") if block_us is None else F.lit(block_us)
    ends = ends.withColumn("part", part.cast("long"))
    dealt = met(keyed.where("t IS NOT NULL"), ends, "s").withColumn("block", F.expr("(t - lo) div part")).drop("part")
    sizes = dealt.groupBy("s", "block").count()
    sizes = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("s").orderBy("block")) - F.col("count")).drop("count")
    n = F.col("before") + F.row_number().over(Window.partitionBy("s", "block").orderBy("t")) - 1
    return met(dealt, sizes, "s", "block").withColumn("n", n)


def packed(rows: DataFrame, station: str, time: str, value: str, block_us: int | None = None) -> DataFrame:
    """(s, n0, size, lo, hi, first, last, begin, end, us, x): a run's rows are numbers ``n0`` and on of ``size``, from 0; the series lasts from ``lo`` to ``hi``.

    ``us`` are 64-bit times, ``x`` doubles; NaN stands for missing. ``begin`` and ``end`` are the first and last two values. Else as ``numbered``.
    """
    dealt = numbered(rows, station, time, value, block_us)
    dealt = dealt.withColumn("sub", F.expr(f"(n - before) div {RUN}"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        return run(*(pdf[c].iat[0] for c in ("s", "n", "size", "lo", "hi")), pdf["t"].to_numpy(np.int64), pdf["v"].to_numpy(np.float64))

    # grouped as they are dealt: no further shuffle
    return dealt.groupBy("s", "block", "sub").applyInPandas(pack, schema(dealt.schema["s"].dataType.simpleString()))


def schema(kind: str) -> str:
    return f"s {kind}, n0 long, size long, lo long, hi long, first long, last long, begin array<double>, end array<double>, us binary, x binary"


def run(s: object, n0: int, size: int, lo: int, hi: int, us: np.ndarray, x: np.ndarray) -> pd.DataFrame:
    """One packed row."""
    columns = ["s", "n0", "size", "lo", "hi", "first", "last", "begin", "end", "us", "x"]
    return pd.DataFrame([(s, n0, size, lo, hi, us[0], us[-1], x[:2].tolist(), x[-2:].tolist(), us.tobytes(), x.tobytes())], columns=columns)


def with_reach(runs: DataFrame, points: int, us: int) -> DataFrame:
    """Runs (r0 is their n0) beside each run of the series that holds rows up to ``points`` numbers or ``us`` of time away, or the row that comes next."""
    places = runs.select("s", "n0", "first", "last", (F.octet_length("us") / 8).cast("long").alias("count"))
    order = Window.partitionBy("s").orderBy("n0")
    places = places.withColumns({"next_first": F.lead("first").over(order), "last_before": F.lag("last").over(order)})
    mine = places.select(F.col("s").alias("ms"), F.col("n0").alias("r0"), F.col("first").alias("mf"), F.col("last").alias("ml"), F.col("count").alias("mc"))
    c = F.col
    left = (c("n0") < c("r0")) & ((c("next_first") > c("mf") - us) | (c("n0") + c("count") > c("r0") - points))
    right = (c("n0") > c("r0")) & ((c("last_before") < c("ml") + us) | (c("n0") < c("r0") + c("mc") + points))
    pairs = places.join(mine, c("s").eqNullSafe(c("ms")) & ((c("n0") == c("r0")) | left | right)).select("s", "n0", "r0")
    return met(pairs, runs.drop("begin", "end"), "s", "n0")


def together(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, slice]:
    """(times, values, number of the first row, place of the run's own rows) of one group (s, r0) of ``with_reach``."""
    pdf = pdf.sort_values("n0")
    us, x = np.frombuffer(b"".join(pdf["us"]), np.int64), np.frombuffer(b"".join(pdf["x"]), np.float64)
    own = pdf[pdf["n0"] == pdf["r0"]].iloc[0]
    first = int(pdf["n0"].iloc[0])
    at = int(own["n0"]) - first
    return us, x, first, slice(at, at + len(own["us"]) // 8)


def replaced(df: DataFrame, station: str, time: str, value: str, new: DataFrame) -> DataFrame:
    """``df`` with the values of ``new`` (station, time, value), which has all its rows."""
    out = new if set(df.columns) == set(new.columns) else met(df.drop(value), new, station, time, how="left")
    return out.select(*df.columns)


def known(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
