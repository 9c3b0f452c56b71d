"""Dense series go in runs of bounded rows, however short their time."""

import pytest
from pyspark.sql import functions as F

from stratus.operators import recursions, runs
from tests.test_frames_and_recursions import _plain


def test_a_dense_series_is_cut_by_rows(spark, monkeypatch):
    """A crowd of rows within a second among years: no run holds more than RUN rows, rows are numbered in order."""
    monkeypatch.setattr(runs, "RUN", 100)
    rows = spark.range(3000).select(F.lit(1).alias("s"), F.when(F.col("id") < 2990, F.col("id")).otherwise((F.col("id") - 2989) * 10**14).alias("t"), F.col("id").cast("double").alias("x"))
    got = runs.packed(rows, "s", "t", "x").select("n0", "first", "size", (F.octet_length("x") / 8).cast("int").alias("n")).orderBy("n0").collect()
    assert sum(r.n for r in got) == 3000 and max(r.n for r in got) <= 100
    assert all(a.n0 + a.n == b.n0 and a.first < b.first for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("both", [True, False])
def test_a_filter_over_many_runs(spark, monkeypatch, both):
    """One month of one series in runs of 50 rows, with the result of one row after the other."""
    monkeypatch.setattr(runs, "RUN", 50)
    points = [(k * 1_000_000, None if k % 29 == 7 else float(k * k % 17)) for k in range(700)]
    rows = spark.createDataFrame([(1, t, x) for t, x in points], "s int, t long, x double")
    f = recursions.coefficients(rows, "s", "t", 30.0).collect()[0]
    got = [r.x for r in recursions.iir(rows, "s", "t", "x", 30.0, both_ways=both).orderBy("t").collect()]
    x = [v for _, v in points]
    x = _plain(x[::-1], f)[::-1] if both else x
    assert got == pytest.approx(_plain(x, f), abs=1e-9)
