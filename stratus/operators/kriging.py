"""Ordinary kriging of station values onto grid cells, with a variogram fitted for each region.

A region's stations give one symmetric linear system. Its solution for the values (not for each cell) leaves a weight for each
station and one constant, so a cell's value is a sum over its region's stations within the row: cells are joined with one row for
each region, and no cell meets stations by a join. The system is dense: a region's stations are one task, their number is checked
against MOST before any work, and a region with more of them is an error, never a sample.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.operators.spatial import lapse

#: Stations of a region at most: 2,000 are a matrix of 32 MB.
MOST = 2_000
#: Pairs up to which all of them are fitted, and equal-count bins beyond.
PAIRS, BINS = 40, 10
#: Fixed values of the fit: share of a parameter that its derivative looks to each side, step for a parameter of zero, end of the iteration.
SHARE, STEP, SMALL, ROUNDS = 0.1, 0.5, 1e-6, 50


@dataclass(frozen=True)
class Variogram:
    """A model of covariance over distance: fewest points, first guess, and the model for numpy and for columns."""

    points: int
    guess: Callable[[np.ndarray, np.ndarray], list[float]]
    of: Callable[[np.ndarray, Sequence[float]], np.ndarray]
    column: Callable[[Column, Column, Column, Column], Column]


def _spheric(d, p):
    r = d / p[2] if p[2] else np.inf
    return p[0] + p[1] * np.where(d <= p[2], 1.5 * r - 0.5 * r**3, 1.0)


VARIOGRAMS = {
    "LINVARIO": Variogram(3, lambda d, v: [v[0], 0.0], lambda d, p: p[0] + p[1] * d, lambda d, a, b, c: a + b * d),
    "SPHERICVARIO": Variogram(4, lambda d, v: [v.min(), v.max(), d.max()], _spheric, lambda d, a, b, c: a + b * F.when(d <= c, 1.5 * d / c - 0.5 * F.pow(d / c, F.lit(3.0))).otherwise(1.0)),
    "EXPVARIO": Variogram(4, lambda d, v: [v[0], v[-1] - v[0], 1.0], lambda d, p: p[0] + p[1] * (1 - np.exp(-d / p[2])), lambda d, a, b, c: a + b * (1 - F.exp(-d / c))),
    "RATQUADVARIO": Variogram(4, lambda d, v: [v[0], v.max(), 1.0], lambda d, p: p[0] + p[1] * d * d / (1 + d * d / p[2]), lambda d, a, b, c: a + b * d * d / (1 + d * d / c)),
}


def binned(d: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points by distance, then value; more than PAIRS of them as means of BINS bins of equal count, the first ones with one more."""
    order = np.lexsort((v, d))
    d, v = d[order], v[order]
    if len(d) <= PAIRS:
        return d, v
    parts = np.array_split(np.arange(len(d)), BINS)
    return np.array([d[k].mean() for k in parts]), np.array([v[k].mean() for k in parts])


def fit(model: str, d: np.ndarray, v: np.ndarray) -> list[float] | None:
    """Parameters by Gauss-Newton steps with central differences; None with too few points, a derivative of no full rank or no end after ROUNDS."""
    kind = VARIOGRAMS[model]
    if len(d) < kind.points:
        return None
    p = np.array(kind.guess(d, v), float)
    for _ in range(ROUNDS):
        steps = np.diag(np.where(p == 0, STEP, SHARE * p))
        with np.errstate(all="ignore"):
            slopes = np.stack([(kind.of(d, p + s) - kind.of(d, p - s)) / (2 * s.sum()) for s in steps], axis=1)
            rest = v - kind.of(d, p)
        scale = np.linalg.norm(slopes, axis=0)
        if not (np.isfinite(slopes).all() and np.isfinite(rest).all() and (scale > 0).all()):
            return None
        by, _, rank, _ = np.linalg.lstsq(slopes / scale, rest, rcond=1e-12)
        if rank < len(p):
            return None
        p = p + by / scale
        if np.abs(by / scale).max() <= SMALL:
            return [float(x) for x in p]
    return None


def _solved(pdf: pd.DataFrame, models: list[str]) -> tuple[str | None, list[float], float | None, np.ndarray]:
    """(model, three parameters, constant, weights) of a region; no model and no constant where none can be fitted."""
    z, x, y = (pdf[c].to_numpy(float) for c in ("value", "x", "y"))
    n, none = len(z), np.zeros(len(z))
    if n == 1 or not z.any():
        return "CST", [0.0] * 3, float(z[0]), none
    i, j = np.triu_indices(n, 1)
    d = np.hypot(x[i] - x[j], y[i] - y[j])
    apart = d > 0
    points = binned(d[apart], (z[i] - z[j])[apart] ** 2 / d[apart])
    for model in models:
        p = fit(model, *points)
        if p is None:
            continue
        system = np.ones((n + 1, n + 1))
        system[n, n] = 0.0
        system[i, j] = system[j, i] = np.where(apart, VARIOGRAMS[model].of(d, p), 0.0)
        try:
            *weights, constant = np.linalg.solve(system, np.append(z, 0.0))
        except np.linalg.LinAlgError:
            continue
        return model, [*p, 0.0][:3], float(constant), np.array(weights)
    return None, [0.0] * 3, None, none


def kriging_fits(stations: DataFrame, models: Sequence[str] = ()) -> DataFrame:
    """(region, model, a, b, c, constant, near): each region's variogram, the first of ``models`` that can be fitted or a line, and weights.

    Stations without a value or place do not count, of equal stations all do. Raises ValueError where a region has more than MOST.
    """
    models = [*models, *(["LINVARIO"] if "LINVARIO" not in models else [])]
    known = stations.where("value IS NOT NULL AND NOT isnan(value) AND x IS NOT NULL AND y IS NOT NULL").select("region", "station", "x", "y", F.col("value").cast("double").alias("value"))
    large = known.groupBy("region").count().where(F.col("count") > MOST).limit(1).collect()
    if large:
        raise ValueError(f"region {large[0].region} has {large[0]['count']} stations; kriging takes {MOST} at most, divide it into smaller regions")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["station", "x", "y", "value"])
        model, p, constant, weights = _solved(pdf, models)
        near = [{"x": float(a), "y": float(b), "w": float(w)} for a, b, w in zip(pdf["x"], pdf["y"], weights)]
        return pd.DataFrame({"region": pdf["region"].iloc[:1].to_numpy(), "model": [model], "a": p[0], "b": p[1], "c": p[2], "constant": [constant], "near": [near]})

    kind = stations.schema["region"].dataType.simpleString()
    return known.groupBy("region").applyInPandas(solve, f"region {kind}, model string, a double, b double, c double, constant double, near array<struct<x: double, y: double, w: double>>")


def _at(d: Column) -> Column:
    """The fitted variogram at distance ``d``, 0 at no distance."""
    out = F.when(d == 0, 0.0)
    for model, kind in VARIOGRAMS.items():
        out = out.when(F.col("model") == model, kind.column(d, F.col("a"), F.col("b"), F.col("c")))
    return out.otherwise(0.0)


def kriging(cells: DataFrame, stations: DataFrame, models: Sequence[str] = ()) -> DataFrame:
    """(region, cell, value). One station or zeros alone give a constant; regions without stations or without a model are null."""
    fits = kriging_fits(stations, models)
    there = lambda s: F.hypot(F.col("x") - s["x"], F.col("y") - s["y"])
    total = F.aggregate("near", F.col("constant"), lambda sum_, s: sum_ + s["w"] * _at(there(s)))
    return cells.select("region", "cell", "x", "y").join(fits, "region", "left").select("region", "cell", total.alias("value"))


def kriging_lapse(cells: DataFrame, stations: DataFrame, models: Sequence[str] = ()) -> DataFrame:
    """Kriging of the residuals from the altitude trend, plus the trend at the cell."""
    trend = lapse(stations.where("value IS NOT NULL"))
    at = F.col("slope") * F.col("alt") + F.col("icept")
    flat = stations.join(trend, "region").withColumn("value", F.col("value") - at).drop("slope", "icept")
    found = kriging(cells, flat, models).join(cells.select("region", "cell", "alt"), ["region", "cell"])
    return found.join(trend, "region", "left").select("region", "cell", (F.col("value") + at).alias("value"))
