"""Linear recursions along a series as scans over runs of rows, so that no series is one task.

A recursion y = u + b1 y' + b2 y'' maps the two values before a run to the two at its end, y = M y0 + v. Runs are solved by
themselves from zero, the maps of a series (one small row for each run) give the values before each run, and from those its rows
are solved again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.operators.runs import known, met, packed, replaced, run, schema
from stratus.operators.saved import saved

#: Polynomial (g, p) and cutoff correction of two passes for each type of filter.
_TYPES = {
    "BUTTERWORTH": (1.0, math.sqrt(2.0), 1 / math.pow(math.sqrt(2.0) - 1, 0.25)),
    "CRITICALLY_DAMPED": (1.0, 2.0, math.sqrt(math.pow(2.0, 0.25) - 1)),
    "BESSEL": (3.0, 3.0, math.sqrt(math.sqrt(math.sqrt(2.0) - 0.75) - 0.5) / math.sqrt(3.0)),
}


def coefficients(rows: DataFrame, station: str, time: str, cutoff: float, response: str = "LP", kind: str = "CRITICALLY_DAMPED") -> DataFrame:
    """(station, a0, a1, a2, b1, b2) of a two-pole filter from the mean sampling rate of each series; no row for a series without two times."""
    ends = rows.groupBy(station).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))
    return _factors(ends, station, cutoff, response, kind)


def _factors(ends: DataFrame, station: str, cutoff: float, response: str, kind: str) -> DataFrame:
    """``coefficients`` from (station, first, last, n) of each series."""
    g, p, c = _TYPES[kind]
    correction = 1 / c if response == "LP" else c
    ends = ends.where("last > first")
    ratio = correction / cutoff / ((F.col("n") - 1) / ((F.col("last") - F.col("first")) / 1e6))
    w = F.tan(math.pi * (ratio if response == "LP" else 0.5 - ratio))
    k1, k2 = p * w, g * w * w
    a0 = k2 / (1 + k1 + k2)
    b1 = 2 * a0 * (1 / k2 - 1)
    b2 = 1 - (4 * a0 + b1)
    sign = 1 if response == "LP" else -1
    return ends.select(station, a0.alias("a0"), (sign * 2 * a0).alias("a1"), a0.alias("a2"), (sign * b1).alias("b1"), b2.alias("b2"))


def _solved(x: np.ndarray, u: np.ndarray, seeded: np.ndarray, b1: float, b2: float, y1: float, y2: float) -> np.ndarray:
    """The recursion from the two values before; a seeded row takes its own value (or none)."""
    out = []
    for value, drive, own in zip(x.tolist(), u.tolist(), seeded.tolist(), strict=True):
        y = value if own else drive + b1 * y1 + b2 * y2
        out.append(y)
        # a missing value is never read again: the two rows after it are seeded
        y1, y2 = (0.0 if y != y else y), y1
    return np.array(out)


def second_order(runs: DataFrame, factors: DataFrame, backward: bool = False, whole: bool = True) -> DataFrame:
    """Packed ``runs``, filtered by ``factors`` (s, a0, a1, a2, b1, b2) along the series, or from its end to its start; as rows (s, t, v) if not ``whole``.

    A row with itself or one of the two rows before it missing, or with fewer than two before it, keeps its value. A series without factors keeps all.
    """
    kind = runs.schema["s"].dataType.simpleString()
    series = Window.partitionBy("s").orderBy(F.desc("n0") if backward else F.col("n0"))
    none, unknown = F.array().cast("array<double>"), F.lit(float("nan"))
    tails = runs.select("s", "n0", (F.reverse("begin") if backward else F.col("end")).alias("tail"))
    # two runs are enough: each has a row at least
    before = F.concat(F.array(unknown, unknown), F.coalesce(F.lag("tail", 2).over(series), none), F.coalesce(F.lag("tail", 1).over(series), none))
    heads = met(tails.select("s", "n0", F.slice(before, -2, 2).alias("head")), factors, "s", how="left")

    def parts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        """(values, drive, seeded, b1, b2) of one run, in the order of the recursion."""
        one = pdf.iloc[0]
        x = np.frombuffer(one["x"], np.float64)[:: -1 if backward else 1]
        led = np.concatenate([np.asarray(one["head"], float), x])
        now, first, second = led[2:], led[1:-1], led[:-2]
        a0, a1, a2, b1, b2 = (float(one[c]) for c in ("a0", "a1", "a2", "b1", "b2"))
        seeded = np.isnan(now) | np.isnan(first) | np.isnan(second) | (b1 != b1)
        return x, a0 * now + a1 * first + a2 * second, seeded, b1, b2

    def to_end(pdf: pd.DataFrame) -> pd.DataFrame:
        """The last two rows of a run solved from zeros, and what 1 in the place of each of the two values before it adds to them; seeded rows take nothing over."""
        x, u, seeded, b1, b2 = parts(pdf)
        h = np.zeros((2, len(x)))
        for k, (y1, y2) in enumerate(((1.0, 0.0), (0.0, 1.0))):
            for i, own in enumerate(seeded.tolist()):
                y1, y2 = 0.0 if own else b1 * y1 + b2 * y2, y1
                if not (y1 or y2):
                    break
                h[k, i] = y1
        y = np.nan_to_num(_solved(x, u, seeded, b1, b2, 0.0, 0.0)[-2:], nan=0.0)
        return pd.DataFrame({"s": pdf["s"], "n0": pdf["n0"], "y": [y.tolist()], "h1": [h[0, -2:].tolist()], "h2": [h[1, -2:].tolist()]})

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        """The two values before each run of one series."""
        pdf, out, y1, y2 = pdf.sort_values("n0", ascending=not backward), [], 0.0, 0.0
        for ends in zip(pdf["y"], pdf["h1"], pdf["h2"], strict=True):
            out.append((y1, y2))
            for y, h1, h2 in zip(*ends, strict=True):
                y1, y2 = y + h1 * out[-1][0] + h2 * out[-1][1], y1
        return pdf[["s", "n0"]].assign(y1=[a for a, _ in out], y2=[b for _, b in out])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        y = _solved(*parts(pdf), float(pdf["y1"].iat[0]), float(pdf["y2"].iat[0]))[:: -1 if backward else 1]
        us = np.frombuffer(pdf["us"].iat[0], np.int64)
        if not whole:
            return pd.DataFrame({"s": pdf["s"].iat[0], "t": us, "v": y})
        return run(*(pdf[c].iat[0] for c in ("s", "n0", "size", "lo", "hi")), us, y)

    ends = met(runs.select("s", "n0", "x"), heads, "s", "n0").groupBy("s", "n0").applyInPandas(to_end, f"s {kind}, n0 long, y array<double>, h1 array<double>, h2 array<double>")
    states = ends.groupBy("s").applyInPandas(carry, f"s {kind}, n0 long, y1 double, y2 double")
    ready = met(runs.drop("begin", "end"), met(heads, states, "s", "n0"), "s", "n0")
    return ready.groupBy("s", "n0").applyInPandas(solve, schema(kind) if whole else f"s {kind}, t long, v double")


def iir(rows: DataFrame, station: str, time: str, value: str, cutoff: float, response: str = "LP", kind: str = "CRITICALLY_DAMPED", both_ways: bool = True, block_us: int | None = None) -> DataFrame:
    """Low (LP) or high (HP) pass of two poles with a ``cutoff`` period in seconds: backward and then forward, or forward only.

    Times of a series are distinct. Its rows are numbered in parts of ``block_us``, or of as much time as an average run.
    """
    runs = saved(packed(rows, station, time, value, block_us), "runs")
    ends = runs.groupBy("s").agg(F.first("lo").alias("first"), F.first("hi").alias("last"), F.first("size").alias("n"))
    factors = _factors(ends, "s", cutoff, response, kind)
    if both_ways:
        runs = saved(second_order(runs, factors, backward=True), "backward")
    out = second_order(runs, factors, whole=False)
    return replaced(rows, station, time, value, out.select(F.col("s").alias(station), F.col("t").alias(time), known(F.col("v")).alias(value)))
