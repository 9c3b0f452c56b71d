"""Grids resized by hand."""

import pytest

from stratus.operators.regrid import resize


def _grid(spark, rows):
    """Rows from south to north."""
    return spark.createDataFrame([(1, i, j, v) for j, r in enumerate(rows) for i, v in enumerate(r)], "grid int, i int, j int, value double")


def _values(df):
    got = {(r.i, r.j): r.value for r in df.collect()}
    return [[got[i, j] for i in range(max(k[0] for k in got) + 1)] for j in range(max(k[1] for k in got) + 1)]


def test_a_plane_stays_a_plane(spark):
    plane = [[10.0 * i + j for i in range(7)] for j in range(6)]
    for method in ("BILINEAR", "BSPLINE"):
        got = _values(resize(_grid(spark, plane), 2.0, method))
        inner = [(i, j) for i in range(2, 9) for j in range(2, 7)]
        assert [got[j][i] for i, j in inner] == pytest.approx([10 * i / 2 + j / 2 for i, j in inner])


def test_nearest_and_gaps(spark):
    rows = [[1.0, 2.0, 3.0], [4.0, None, 6.0], [7.0, None, 9.0]]
    assert _values(resize(_grid(spark, rows), 2.0, "NEAREST"))[2:4] == [[4.0, 4.0, None, None, 6.0, 6.0]] * 2
    got = _values(resize(_grid(spark, rows), 2.0, "BILINEAR"))
    assert got[1][1] == pytest.approx((1 + 2 + 4 + 7 / 3) / 4)
    assert got[2][0] is None  # two of four are known
    assert got[0][5] == 3.0 and got[5][4] == 9.0  # the last column and row are as they were
    assert _values(resize(_grid(spark, rows), 0.5, "NEAREST")) == [[1.0, 2.0], [4.0, None]]


def test_splines_do_not_overshoot(spark):
    rows = [[0.0] * 4, [0.0, 9.0, 0.0, 0.0], [0.0] * 4, [0.0] * 4]
    got = _values(resize(_grid(spark, rows), 3.0, "BSPLINE"))
    assert min(map(min, got)) == 0.0 and got[3][3] == pytest.approx(9.0 * 4 / 9)


def test_no_grid_and_no_cells(spark):
    assert resize(_grid(spark, [[1.0]]), 0.4).collect() == []
    assert resize(_grid(spark, [[1.0]]).limit(0), 2.0).collect() == []
    with pytest.raises(ValueError, match="factor"):
        resize(_grid(spark, [[1.0]]), 0.0)
