"""Formulas against their values in doubles, conditions row by row, and what is refused."""

import math

import pytest
from pyspark.sql import functions as F

from stratus.operators.formulas import Condition, formula, maths

INF, NAN = math.inf, math.nan
CASES = {
    "1 + 2 * 3 - 4 / 8": 6.5, "(1 + 2) * 3": 9.0, "2 ^ 3 ^ 2": 64.0, "-2^2": 4.0, "2^-1": 0.5, "- -3": 3.0, "7 % 4": 3.0, "-7 % 4": -3.0, "5.5%2": 1.5, "7 % 0": NAN, "1/0": INF, "-1/0": -INF, "0/0": NAN,
    "1e3 + .5": 1000.5, "fac(5)": 120.0, "fac 0": 1.0, "fac(20)": 2432902008176640000.0, "fac(21)": INF, "fac(-1)": NAN, "ncr(5, 2)": 10.0, "ncr(3,5)": NAN, "ncr(60,30)": 118264581564861424.0, "npr(5,2)": 20.0, "ncr(-1, 0)": NAN,
    "log(1000)": 3.0, "log10 100": 2.0, "ln(e^2)": 2.0, "ln(0)": -INF, "ln(-1)": NAN, "sqrt 16 + 9": 13.0, "sqrt(-1)": NAN, "acos(2)": NAN, "floor(-1.5)": -2.0, "ceil(1.2)": 2.0, "floor(1/0)": INF, "floor(0/0)": NAN,
    "abs(-3)": 3.0, "atan2(1, 1) * 4 / pi": 1.0, "pow(2, 10)": 1024.0, "meteo(A) + meteo(b)": -989.0, "meteo(Nowhere)": -999.0, "nodata": -999.0, "stdpress": 101325.0, "altitude": 1500.0, "latitude": -999.0,
    "year * 10000 + month * 100 + day": 20240229.0, "hour * 60 + minute": 755.0, "julian": 2460370.0 + 35 / 1440,
}


def _row(spark):
    t = 1_709_210_100_000_000  # 2024-02-29 12:35
    return spark.createDataFrame([(10.0, None, 1500, t, "ISEE3")], "A double, b double, alt int, t long, id string")


def test_values(spark):
    df = _row(spark)
    row = df.select(*(formula(df, text, "t", {"altitude": "alt"}).alias(str(k)) for k, text in enumerate(CASES))).first()
    for k, (text, value) in enumerate(CASES.items()):
        assert row[str(k)] == pytest.approx(value, rel=1e-12, nan_ok=True), text


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1)", "1 2", "id", "current_user()", "meteo()", "A", "atan2(1)", "1; 2", "'a'", "year", "Sqrt(4)"])
def test_refused(spark, text):
    with pytest.raises(ValueError, match="formula"):
        formula(_row(spark), text)


@pytest.mark.parametrize(
    ("conditions", "connective", "holds"),
    [
        ([], "AND", True), ([("1", "LT", "2"), ("2", "GT", "3")], "AND", False), ([("1", "LT", "2"), ("2", "GT", "3")], "or", True), ([("1", "GE", "2"), ("3", "LE", "2")], "OR", False),
        ([("0/0", "EQ", "0/0")], "AND", False), ([("0/0", "NE", "1")], "AND", True), ([("0/0", "GT", "1")], "AND", False), ([("meteo(b)", "EQ", "nodata")], "AND", True),
        ([("stationid", "STRCMP", "ISEE3")], "AND", True), ([("stationid", "STRBEG", "SEE")], "AND", False), ([("stationid", "STREND", "3")], "AND", True), ([("x-stationid", "STRINC", "-IS")], "AND", True), ([("stationname", "STRCMP", "stationname")], "AND", True),
    ],
)
def test_conditions(spark, conditions, connective, holds):
    got = maths(_row(spark), "A", "1", "2", [Condition(*c) for c in conditions], connective, station="id").first().A
    assert got == (1.0 if holds else 2.0)


def test_missing_and_assigned(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 6.0), (4.0, None)], "x double, y double")
    rows = lambda d: [tuple(r) for r in d.collect()]
    assert rows(maths(df, "x", "meteo(X) * 2")) == [(2.0, 5.0), (-1998.0, 6.0), (8.0, None)]
    assert rows(maths(df, "x", "meteo(X) * 2", skip_nodata=True)) == [(2.0, 5.0), (None, 6.0), (8.0, None)]
    assert rows(maths(df, "x", "0/0", assign="y", skip_nodata=True)) == [(1.0, None), (None, 6.0), (4.0, None)]
    assert rows(maths(df, "x", "nodata", None, [Condition("meteo(x)", "GT", "2")])) == [(1.0, 5.0), (None, 6.0), (None, None)]
    assert rows(maths(df, "x", "meteo(x)", assign="z")) == [(1.0, 5.0, 1.0), (None, 6.0, None), (4.0, None, 4.0)]
    with pytest.raises(ValueError, match="operator"):
        maths(df, "x", "1", None, [Condition("1", "LIKE", "1")])
    assert maths(df.where(F.lit(False)), "x", "1").collect() == []
