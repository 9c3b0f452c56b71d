"""Filters on frames of thousands of rows: in runs of any length, against a plain search, and fast where all frames together are long."""

import random
import statistics
import time

import pytest

from stratus.operators import frames, runs
from tests.test_frames_and_recursions import _rows, _span

KINDS = {"lh": ("left", False), "rh": ("right", False), "ch": ("center", False), "ls": ("left", True), "rs": ("right", True)}


def _plain(rows, i, place, name, kind):
    """Value of row i by its frame."""
    x, soft = rows[i][1], kind[1]
    if x is None:
        return None
    v = None if place is None else [y for _, y in rows[place[0] : place[1] + 1] if y is not None]
    if name == "std":
        if v is None or len(v) < 2:
            return x if soft else None
        return None if abs(x - statistics.fmean(v)) > 1.5 * statistics.stdev(v) else x
    if not v:
        return x
    m = statistics.median(v)
    return None if abs(x - m) > 3 * max(statistics.median(abs(y - m) for y in v) / 0.6745, 0.5) else x


@pytest.mark.parametrize("run", [2, 65_536])
@pytest.mark.parametrize(("points", "seconds"), [(1, 6), (4, 3), (6, 50)])
def test_filters_in_runs(spark, monkeypatch, run, points, seconds):
    monkeypatch.setattr(runs, "RUN", run)
    r, series = random.Random(5), {}
    for s in range(12):
        t, now = [], 0
        for _ in range(r.choice([1, 2, 3, 9, 40])):
            now += r.choice([1, 1, 1, 2, 5, 40])
            t.append(now)
        series[s] = [(k, None if r.random() < 0.2 else r.uniform(0, 3) if r.random() < 0.8 else 50.0) for k in t]
    series[12] = [(k, 5.0) for k in range(9)]
    df = _rows(spark, series)
    got = {"std": frames.std_devs(df, "s", "t", "x", KINDS, 1.5, points, seconds), "mad": frames.mads(df, "s", "t", "x", KINDS, 0.5, points, seconds)}
    got = {(name, r.s, r.t // 1_000_000, r.kind): r.x for name, f in got.items() for r in f.collect()}
    assert len(got) == 2 * len(KINDS) * sum(map(len, series.values()))
    for s, rows in series.items():
        t = [k for k, _ in rows]
        for i, k in enumerate(t):
            for kind, (centering, soft) in KINDS.items():
                place = _span(t, i, points, seconds, centering, soft)
                for name in ("std", "mad"):
                    assert got[name, s, k, kind] == _plain(rows, i, place, name, KINDS[kind]), (name, s, k, kind, place)


def test_long_frames_cost_no_more_than_short_ones(spark):
    df = spark.range(60_000).selectExpr("1L AS s", "id * 1000000 AS t", "CASE WHEN id % 1000 = 0 THEN 1e6 ELSE CAST(pmod(xxhash64(id), 1000) AS DOUBLE) END AS x")
    began = time.time()
    for f in (frames.std_dev, frames.mad):
        out = f(df, "s", "t", "x", centering="left", points=1, seconds=20_000)
        assert out.where("x = 1e6").count() == (20 if f is frames.mad else 0)  # the first frame of mad is at row 20,000
    assert time.time() - began < 60


def test_other_columns_and_null_stations_stay(spark):
    df = spark.createDataFrame([(None, k * 1_000_000, "a", float(k)) for k in range(5)] + [(7, 0, "b", None)], "s long, t long, more string, x double")
    assert sorted(map(str, frames.mad(df, "s", "t", "x", points=1, seconds=1, centering="left").collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError, match="point"):
        frames.std_dev(df, "s", "t", "x", points=0)
