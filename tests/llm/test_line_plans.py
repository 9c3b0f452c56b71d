"""Rows of a band are dealt once for both sides of their join, and minima of two shingles take no branch."""

import pytest

from stratus.llm import line_dedup

TEXT = "\n".join(f"a line that begins like all the others of this text and goes on with {k * 7919} and {k * 104729 % 977}" for k in range(40))


@pytest.fixture
def static(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows which exchange is read again
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", old)


def test_bands_are_dealt_once(static, monkeypatch):
    plans, real = {}, line_dedup.saved
    monkeypatch.setattr(line_dedup, "ROWS", 1)  # bands with many lines, of which few are alike
    monkeypatch.setattr(line_dedup, "BANDS", 2)

    def saved(df, tag):
        plans.setdefault((tag, "ocomp" in df.columns), df._jdf.queryExecution().executedPlan().toString().split("\n"))
        return real(df, tag)

    monkeypatch.setattr(line_dedup, "saved", saved)
    line_dedup.line_links(line_dedup.lines_of(static.createDataFrame([(1, TEXT)], "doc_id long, text string"))).collect()
    for step in (("shared", False), ("pairs", True)):
        dealt = [x for x in plans[step] if "hashpartitioning(band" in x]
        assert sum("ReusedExchange" in x for x in dealt) == 1 and len(dealt) == 2, step


def test_minima_take_no_branch(spark):
    plan = line_dedup._signs(spark.createDataFrame([(1, "a line of some words")], "id long, line string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "if (" not in plan and "CASE" not in plan


def test_repeated_shingles_count_once(spark):
    """Lines that are one period over and over, and a pair of which one has its shingles twice."""
    head = "".join(chr(97 + k * 7 % 26) + str(k % 10) for k in range(30))
    rows = [(1, "ab" * 900), (2, "ab" * 20), (3, head + head), (4, head)]
    texts = line_dedup._sketched(spark.createDataFrame(rows, "id long, line string"))
    pairs = spark.createDataFrame([(i, j) for i, _ in rows for j, _ in rows if i < j], "id long, other long")
    sets = {i: {s[k : k + 9] for k in range(len(s) - 8)} for i, s in rows}
    want = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {(r.u, r.v) for r in line_dedup._confirmed(pairs, texts, 80).collect()} == want == {(1, 2), (3, 4)}
