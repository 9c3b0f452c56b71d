"""Rows of a hub are dealt into parts, other keys meet their facts once; signatures and sketches keep no state for each shingle."""

import random

import pytest
from pyspark.sql import functions as F

from stratus.llm import components, line_dedup


@pytest.mark.parametrize("hub", [3, 1000])
def test_only_hubs_are_dealt(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    r = random.Random(4)
    rows = [(1, v) for v in range(40)] + [(r.randrange(2, 30), v) for v in range(60)]
    links = spark.createDataFrame(rows, "u long, v long")
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    met = components.salted(links, least).select("u", "v", "m", "salt").collect()
    want = {u: min(v for x, v in rows if x == u) for u, _ in rows}
    assert sorted((x.u, x.v, x.m) for x in met) == sorted((u, v, want[u]) for u, v in rows)
    size = {u: sum(x == u for x, _ in rows) for u in want}
    assert all(x.salt == 0 for x in met if size[x.u] <= hub)
    assert (len({x.salt for x in met if x.u == 1}) > 5) == (hub == 3)
    ends = {x.id: x.component for x in components.components(spark.createDataFrame([(u, v + 100) for u, v in rows], "u long, v long")).collect()}
    assert all(ends[u] == ends[v + 100] == min(ends[u], u) for u, v in rows)


def test_lines_of_large_groups_go_once(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 3)
    docs = spark.createDataFrame([(k, f"the same line in all of them\nown line number {k * 7919} and {k * 104729} here\nonly once or twice {k // 2 * 65537}") for k in range(12)], "doc_id long, text string")
    found = {x.doc_id: x.removed for x in line_dedup.removed_lines(docs).collect()}
    assert 0 not in found and all(0 in found[k] for k in range(1, 12)) and all((2 in found.get(k, [])) == (k % 2 == 1) for k in range(12))


def test_no_state_for_a_shingle(spark):
    lines = spark.createDataFrame([(1, "a line of some words")], "id long, line string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(line_dedup._signs(lines)).count("least(") == 1 and plan(line_dedup._sketched(lines)).count("Aggregate") == 1
