"""Window frames and two-pole filters against plain Python on short series with gaps, ties of distance and missing values."""

import random
import statistics

import pytest

from stratus.operators import frames, recursions

US = 1_000_000


def _span(t, i, points, seconds, centering, soft):
    """First and last place of row i's frame by the rules of frames, found by search; None without one."""
    n, half = len(t), seconds / 2
    at_or_before = lambda v: max((k for k in range(n) if t[k] <= v), default=None)
    at_or_after = lambda v: min((k for k in range(n) if t[k] >= v), default=None)
    if centering == "left":
        start = at_or_before(t[i] - seconds)
        if not soft:
            return None if start is None or i < points - 1 else (min(start, i - points + 1), i)
        lo = min(0 if start is None else start, max(0, i - points + 1))
        end = at_or_after(t[lo] + seconds) if t[lo] + seconds > t[i] else i
        hi = max(n - 1 if end is None else end, lo + points - 1, i)
        return (lo, hi) if hi < n else None
    if centering == "right":
        end = at_or_after(t[i] + seconds)
        if not soft:
            return None if end is None or i + points > n else (i, max(end, i + points - 1))
        hi = max(n - 1 if end is None else end, min(n - 1, i + points - 1))
        lo = i
        if t[hi] - seconds < t[i]:
            lo = at_or_after(t[hi] - seconds)
            if t[hi] - seconds < t[0]:
                return None
            lo = lo if lo == i else lo - 1
        lo = min(lo, hi - points + 1, i)
        return (lo, hi) if lo >= 0 else None
    a, b, side = at_or_before(t[i] - half), at_or_after(t[i] + half), points // 2
    if a is None or b is None or i < side or i + side >= n:
        return None
    left, right = max(i - a, side), max(b - i, side)
    return (i - left, i + right) if left == right else None


@pytest.fixture(scope="module")
def series():
    r = random.Random(4)
    out = {}
    for s in range(40):
        t, now = [], 0
        for _ in range(r.choice([1, 2, 3, 5, 9, 30])):
            now += r.choice([1, 1, 1, 2, 5, 40])
            t.append(now)
        out[s] = [(k, None if r.random() < 0.2 else float(r.choice([0, 1, 2, 3, 50]))) for k in t]
    return out


def _rows(spark, series):
    return spark.createDataFrame([(s, t * US, x) for s, rows in series.items() for t, x in rows], "s long, t long, x double").repartition(4)


@pytest.mark.parametrize(("centering", "soft"), [("left", False), ("right", False), ("center", False), ("left", True), ("right", True)])
@pytest.mark.parametrize(("points", "seconds"), [(1, 6), (4, 3)])
def test_frames(spark, series, centering, soft, points, seconds):
    got = {(r.s, r.t // US): None if r.frame is None else sorted(r.frame["values"]) for r in frames.framed(_rows(spark, series), "s", "t", "x", frames.VALUES, centering, points, seconds, soft).collect()}
    moments = {(r.s, r.t // US): r.frame for r in frames.framed(_rows(spark, series), "s", "t", "x", frames.MOMENTS, centering, points, seconds, soft).collect()}
    for s, rows in series.items():
        t = [k for k, _ in rows]
        for i, k in enumerate(t):
            place = _span(t, i, points, seconds, centering, soft)
            want = None if place is None else sorted(x for _, x in rows[place[0] : place[1] + 1] if x is not None)
            assert got[s, k] == want
            m = moments[s, k]
            assert (m is None) == (want is None)
            if want:
                assert m["n"] == len(want) and abs(m["mean"] - statistics.fmean(want)) < 1e-9 and abs(m["var"] - statistics.pvariance(want)) < 1e-6


def test_frames_need_a_point(spark, series):
    with pytest.raises(ValueError, match="point"):
        frames.framed(_rows(spark, series), "s", "t", "x", frames.VALUES, points=0)


def _plain(x, f):
    """One row after the other, as the recursion is written."""
    out = []
    for i, v in enumerate(x):
        if i < 2 or None in x[i - 2 : i + 1] or f is None:
            out.append(v)
        else:
            out.append(f["a0"] * x[i] + f["a1"] * x[i - 1] + f["a2"] * x[i - 2] + f["b1"] * out[i - 1] + f["b2"] * out[i - 2])
    return out


@pytest.mark.parametrize("block", [1, 3])
@pytest.mark.parametrize(("response", "kind", "both"), [("LP", "CRITICALLY_DAMPED", True), ("HP", "BUTTERWORTH", True), ("LP", "BESSEL", False)])
def test_two_poles_in_blocks_of_any_length(spark, series, block, response, kind, both):
    rows = _rows(spark, series)
    factors = {r.s: r for r in recursions.coefficients(rows, "s", "t", 30.0, response, kind).collect()}
    got = {(r.s, r.t // US): r.x for r in recursions.iir(rows, "s", "t", "x", 30.0, response, kind, both, block * US).collect()}
    for s, points in series.items():
        x, f = [v for _, v in points], factors.get(s)
        x = _plain(x[::-1], f)[::-1] if both else x
        for (t, _), want in zip(points, _plain(x, f), strict=True):
            assert (got[s, t] is None) == (want is None)
            assert want is None or abs(got[s, t] - want) < 1e-6 * max(1, abs(want))
