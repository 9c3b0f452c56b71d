"""Every core query on the small tables against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from stratus.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _norm(rows):
    return sorted(tuple("~" if v is None or v != v else f"{v + 0.0:.4f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    assert rows
    if name in ORACLES:
        assert _norm(rows) == _norm(db.sql(ORACLES[name]).select(*(f'"{c}"' for c in cols)).fetchall())


def test_rate_left_remembers_the_last_accepted(spark):
    from stratus.operators.filters import rate_left

    df = spark.createDataFrame([(1, k * 1_000_000, x) for k, x in enumerate([0.0, 50.0, 1.0, None, 2.0])], "s long, t long, x double")
    assert [r.x for r in rate_left(df, "s", "t", "x", 1.0).orderBy("t").collect()] == [0.0, None, 1.0, None, 2.0]


def test_smet_and_arc_round_trip(spark, tmp_path):
    from stratus.sources.grids import read_arc
    from stratus.sources.smet import read_smet, write_smet

    (tmp_path / "a.smet").write_text("SMET 1.1 ASCII\n[HEADER]\nstation_id = A\nnodata = -999\ntz = 1\nfields = timestamp TA HS\nunits_multiplier = 1 1 0.01\nunits_offset = 0 273.15 0\n[DATA]\n2008-12-01T01:00 1.5 150\n2008-12-01T02:00 -999 20\n")
    got = {(str(r.ts), r.param): r.value for r in read_smet(spark, str(tmp_path / "a.smet")).collect()}
    assert got == {("2008-12-01 00:00:00", "TA"): 274.65, ("2008-12-01 00:00:00", "HS"): 1.5, ("2008-12-01 01:00:00", "TA"): None, ("2008-12-01 01:00:00", "HS"): 0.2}
    write_smet(read_smet(spark, str(tmp_path / "a.smet")), str(tmp_path / "out"), ["TA", "HS"])
    again = {(str(r.ts), r.param): r.value for r in read_smet(spark, str(tmp_path / "out" / "*")).collect()}
    assert again == got
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 10\nNODATA_value -9999\n1 2\n3 -9999\n")
    assert {(r.i, r.j): r.value for r in read_arc(spark, str(tmp_path / "g.asc")).collect()} == {(0, 1): 1.0, (1, 1): 2.0, (0, 0): 3.0, (1, 0): None}


def test_stream_of_hourly_means(spark, tmp_path):
    from stratus.streaming.quality import hourly_means

    batch = spark.sql("SELECT 1L AS s, timestamp'2020-01-01 00:10:00' + make_interval(0,0,0,0,k) AS ts, CAST(k AS DOUBLE) AS x FROM (SELECT explode(sequence(0, 5)) AS k)")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = hourly_means(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "s", "ts", "x", 0.0, 3.0)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hourly").where("n = 1").count() == 4


def test_precipitation_parts_come_from_each_other(spark):
    from pyspark.sql import functions as F

    from stratus.operators.generators import split_precipitation

    cases = [(2.0, 0.25, None, None), (None, None, 0.5, 1.5), (None, 0.25, 0.5, None), (None, 0.25, None, 1.5), (2.0, None, 0.5, None), (2.0, None, None, None), (0.0, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(cases, "p double, f double, l double, s double")
    got = [tuple(r) for r in df.select(*split_precipitation(F.col("p"), F.col("f"), F.col("l"), F.col("s"), F.lit(0.25))).collect()]
    whole = (2.0, 0.25, 0.5, 1.5)
    assert got[0] == got[2] == got[3] == got[5] == whole
    assert got[1] == whole
    assert got[4] == whole
    assert got[6] == (0.0, 0.0, 0.0, 0.0)
    assert got[7] == (None, None, None, None)


def test_wma_and_exp_smoothing_average_the_pairs(spark):
    from pyspark.sql import functions as F

    from stratus.operators import corrections, filters

    df = spark.createDataFrame([(1, k, x) for k, x in enumerate([1.0, 2.0, None, 6.0, 8.0])], "s long, t long, x double")
    w = filters.over("s", time="t")
    got = {r.t: (r.a, r.b) for r in df.select("t", filters.wma(F.col("x"), w, 2).alias("a"), corrections.exp_smoothing(F.col("x"), w, 2, 0.25).alias("b")).collect()}
    assert got[2] == ((2 * 4.0 + 4.5) / 3, 0.25 * 4.5 + 0.75 * 4.0)
    assert got[1] == ((3 * 2.0 + 2 * 1.0 + 6.0) / 6, 0.25 * 6.0 + 0.75 * 1.0)


def test_accumulate_deals_a_value_over_its_time(spark):
    from stratus.operators.series import accumulate

    df = spark.createDataFrame([(1, 5, 1.0), (1, 25, 4.0), (1, 28, None), (1, 40, 3.0)], "s long, t long, x double")
    assert {r.t: r.x for r in accumulate(df, "s", "t", "x", 10).collect()} == {10: 1.0, 20: 2.0, 30: 1.5, 40: 2.5}


def test_daily_average_without_neighbours_is_a_sinusoid(spark):
    from stratus.operators.series import daily_average

    hour = 3_600_000_000
    obs = spark.createDataFrame([(1, 12 * hour, 5.0), (1, 60 * hour, None)], "s long, t long, x double")
    grid = spark.createDataFrame([(1, k * hour) for k in (6, 12, 18, 24, 30)], "s long, t long")
    got = {r.t // hour: r.x for r in daily_average(obs, grid, "s", "t", "x", 2.0).collect()}
    assert got[30] is None
    assert [round(got[k], 9) for k in (6, 12, 18, 24)] == [5.0, 7.0, 5.0, 3.0]


def test_csv_and_grid_writer(spark, tmp_path):
    from stratus.sources.csv import read_csv
    from stratus.sources.grids import read_arc, write_arc

    (tmp_path / "a.csv").write_text("when;temp;snow\n01.12.2008 01:00;1.5;150\n01.12.2008 02:00;-999;x\n")
    got = read_csv(spark, str(tmp_path / "a.csv"), {"temp": "TA", "snow": "HS"}, "when", "dd.MM.yyyy HH:mm", station_id="A", delimiter=";", tz=1.0, multiplier={"HS": 0.01}, offset={"TA": 273.15})
    rows = {(r.station_id, str(r.ts), r.param): r.value for r in got.collect()}
    assert rows == {("A", "2008-12-01 00:00:00", "TA"): 274.65, ("A", "2008-12-01 00:00:00", "HS"): 1.5, ("A", "2008-12-01 01:00:00", "TA"): None, ("A", "2008-12-01 01:00:00", "HS"): None}
    cells = spark.createDataFrame([("g", i, j, i * 10.0, j * 10.0, float(i + 10 * j) if (i, j) != (1, 0) else None) for i in range(3) for j in (0, 2)], "grid string, i int, j int, x double, y double, value double")
    write_arc(cells, str(tmp_path / "grid"), 10.0)
    back = {(r.i, r.j): r.value for r in read_arc(spark, str(tmp_path / "grid" / "*")).collect()}
    assert back == {(i, j): None if j == 1 or (i, j) == (1, 0) else float(i + 10 * j) for i in range(3) for j in range(3)}


def test_time_loop_covers_both_sides(spark):
    from stratus.operators.series import time_loop

    df = spark.createDataFrame([(10,), (12,), (15,)], "t long")
    assert sorted(r.t for r in time_loop(df, "t", (10, 15), (6, 20)).collect()) == [7, 10, 12, 15, 17, 20]


def test_sun_stands_where_almanacs_have_it(spark):
    from pyspark.sql import functions as F

    from stratus.functions.sun import sun

    df = spark.sql("SELECT unix_micros(t) AS t, lat, lon FROM VALUES (timestamp'2024-06-20 20:51:00', 0D, 0D), (timestamp'2024-03-20 03:06:00', 0D, 0D), (timestamp'2024-06-20 12:02:00', 51.48D, 0D), (NULL, 1D, 1D) AS v(t, lat, lon)")
    s = sun(F.col("t"), F.col("lat"), F.col("lon"))
    got = df.select(s.declination, s.elevation, s.azimuth).collect()
    assert abs(got[0][0] - 23.438) < 0.005 and abs(got[1][0]) < 0.005
    assert abs(got[2][1] - (90 - 51.48 + 23.44)) < 0.01 and abs(got[2][2] - 180) < 0.5
    assert tuple(got[3]) == (None, None, None)
