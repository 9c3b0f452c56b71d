"""Despiking against one row after the other, with runs so short that series span many."""

import math
import os

import numpy as np
import pytest

from stratus.operators import despiking as ds


def _slopes(u, t):
    out = []
    for i, v in enumerate(u):
        got = None
        for k in range(1, 102):
            a, b = i - k, i + k
            stop = a < 0 or b >= len(u)
            a, b = i if a < 0 else a, i if b >= len(u) else b
            if u[a] is not None and u[b] is not None:
                stop, got = True, (u[b] - u[a]) / (t[b] - t[a]) if a != b else None
            if stop:
                break
        out.append(None if v is None else got)
    return out


def _std(x):
    x = [v for v in x if v is not None]
    return float(np.std(x, ddof=1)) if len(x) > 1 else 0.0


def _spikes(u, t, method, sensitivity):
    d1 = _slopes(u, t)
    d2 = _slopes(d1, t)
    known = [v for v in u if v is not None]
    k = math.sqrt(2 * math.log(len(known))) / sensitivity
    if not _std(u):
        return [False] * len(u)
    theta = math.atan(sum(a * b for a, b in zip(u, d2) if a is not None and b is not None) / sum(v * v for v in known))
    co, si = math.cos(theta), math.sin(theta)
    if method == "MORI":
        xyz = [None if a is None or c is None else (a * co + c * si, b, c * co - a * si) for a, b, c in zip(u, d1, d2)]
        axes = [k * _std([None if p is None else p[m] for p in xyz]) for m in range(3)]
        return [p is not None and all(axes) and sum((v / a) ** 2 for v, a in zip(p, axes)) > 1 for p in xyz]
    s0, s1, s2 = _std(u), _std(d1), _std(d2)
    if not (s0 and s1 and s2):
        return [False] * len(u)
    p = np.linalg.solve([[co**2, si**2], [si**2, co**2]], [(k * s0) ** 2, (k * s2) ** 2])
    inside = lambda x, y, a, b: x is None or y is None or not (a > 0 and b > 0) or x * x / a + y * y / b <= 1
    return [
        not (inside(a, b, (k * s0) ** 2, (k * s1) ** 2) and inside(b, c, (k * s1) ** 2, (k * s2) ** 2) and (a is None or c is None or inside(a * co + c * si, a * si - c * co, p[0], p[1])))
        for a, b, c in zip(u, d1, d2)
    ]


def _despiked(x, t, method, sensitivity, degree, points):
    x = list(x)
    for _ in range(50):
        known = [v for v in x if v is not None]
        if not known:
            return x
        mean = sum(known) / len(known)
        spikes = _spikes([None if v is None else v - mean for v in x], t, method, sensitivity)
        new = list(x)
        for i in [i for i, s in enumerate(spikes) if s]:
            good = [j for j in range(len(x)) if x[j] is not None and not spikes[j]]
            left, right = [j for j in good if j < i][-(points // 2) :], [j for j in good if j > i][: points // 2]
            if degree == 0:
                new[i] = None
            elif left and right and len(left) + len(right) > degree:
                at = np.array([t[j] - t[i] for j in left + right])
                new[i] = float(np.linalg.lstsq(np.vander(at, degree + 1, increasing=True), np.array([x[j] for j in left + right]), rcond=None)[0][0])
        end = not any(spikes) or _std(x) <= _std(new)
        x = new
        if end:
            break
    return x


def _series():
    rng = np.random.default_rng(11)
    out = {}
    for s, n in ((1, 260), (2, 400), (3, 6), (4, 1), (5, 330)):
        x = [float(v) for v in 270 + np.sin(np.arange(n) / 9) * 4 + rng.normal(0, 0.2, n)]
        for i in rng.choice(n, n // 25, replace=False):
            x[i] += float(rng.choice([-25.0, 18.0, 40.0]))
        for i in rng.choice(n, n // 6, replace=False):
            x[i] = None
        if s == 5:
            x[40:190] = [None] * 150
        out[s] = (x, [int(k) for k in np.cumsum(rng.integers(1, 4, n)) * 600_000_000])
    out[6] = ([5.0] * 40, [k * 600_000_000 for k in range(40)])
    out[7] = ([None] * 9, [k * 600_000_000 for k in range(9)])
    return out


@pytest.mark.parametrize(("method", "degree", "points"), [("GORING", 3, 24), ("MORI", 2, 6), ("GORING", 0, 24)])
def test_equals_row_by_row(spark, monkeypatch, method, degree, points):
    monkeypatch.setattr(ds, "RUN", 64)
    data = _series()
    df = spark.createDataFrame([(s, t, x) for s, (xs, ts) in data.items() for x, t in zip(xs, ts)], "station int, us long, x double")
    got = {(r.station, r.us): r.x for r in ds.despike(df, "station", "us", "x", method, 1.2, degree, points, block_us=30_000_000_000).collect()}
    assert len(got) == df.count()
    changed = 0
    for s, (xs, ts) in data.items():
        steps = [(t - ts[0]) / (ts[1] - ts[0] if len(ts) > 1 else 1) for t in ts]
        want = _despiked(xs, steps, method, 1.2, degree, points)
        changed += sum(a != b for a, b in zip(xs, want))
        assert [got[s, t] for t in ts] == [None if v is None else pytest.approx(v, abs=1e-6) for v in want], s
    assert changed > 20


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], "station int, us long, x double")
    assert ds.despike(empty, "station", "us", "x").collect() == []
    with pytest.raises(ValueError, match="GORING or MORI"):
        ds.despike(empty, "station", "us", "x", "OTHER")


def test_tables_of_earlier_rounds_are_deleted(spark, monkeypatch):
    """However many rounds: the last one's rows, its moves, and the rows of series that ended are what is left."""
    t = [k * 1_000_000 for k in range(400)]
    rows = [(s, k, float((k // 1_000_000 * (s + 3)) % 7 + (40 * s if k // 1_000_000 % 50 == 9 else 0))) for s in (1, 2, 3) for k in t]
    tables, saved = [], ds.saved
    monkeypatch.setattr(ds, "saved", lambda df, tag: tables.append((tag, saved(df, tag))) or tables[-1][1])
    out = ds.despike(spark.createDataFrame(rows, "s long, t long, x double"), "s", "t", "x", sensitivity=0.6, degree=0)
    left = [tag for tag, df in tables if os.path.exists(df.saved_at.removeprefix("file://"))]
    assert len(tables) > 6
    assert out.count() == 1200 and out.where("x IS NULL").count() > 0
    assert left.count("derived") == left.count("numbered") == left.count("moves") == 0 and left.count("round") == 1 and left.count("ended") <= 2
