"""Sets of a line as hashes, the minima by steps, and how many steps components take."""

import random

from pyspark.sql import functions as F

from stratus.llm import components, line_dedup


def _lines(r):
    out = ["x", "12345678", "123456789", "  padded line here \t", "今日は天気がとても良いので公園まで", "😀😁😂🤣😃😄😅😆😉😊😋", "ab" * 900]
    return [*out, *("".join(r.choice("abc d") for _ in range(r.randint(9, 60))).strip() + "." for _ in range(40))]


def test_sets_and_minima(spark):
    lines = _lines(random.Random(3))
    sets = [{s[k : k + 9] for k in range(max(1, len(s) - 8))} for s in (x.strip(" \t\r\f\x0b") for x in lines)]
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    a, b = (rows.select(F.col("id").alias(f"{p}id"), F.col("line").alias(f"{p}line")) for p in "ab")
    both = a.crossJoin(b).select("aid", "bid", F.size(F.array_intersect(line_dedup._every("aline", 7), line_dedup._every("bline", 7))).alias("n"))
    assert {(r.aid, r.bid): r.n for r in both.collect()} == {(i, j): len(s & t) for i, s in enumerate(sets) for j, t in enumerate(sets)}
    # as a row for each shingle gives them
    g = F.xxhash64(F.encode("s", "UTF-32")).bitwiseAND(F.lit(line_dedup._MASK))
    each = spark.createDataFrame([(k, x) for k, s in enumerate(sets) for x in s], "id long, s string").select("id", g.alias("g"))
    want = each.groupBy("id").agg(*(F.min((F.col("g") * F.lit(f)).bitwiseAND(F.lit(line_dedup._MASK))).alias(f"m{k}") for k, f in enumerate(line_dedup._FACTORS)))
    assert sorted(map(tuple, line_dedup._signs(rows).collect())) == sorted(map(tuple, want.collect()))


def test_stars_end_at_once(spark, monkeypatch):
    steps, real = [], components._large
    monkeypatch.setattr(components, "_large", lambda edges: steps.append(1) or real(edges))
    get = lambda links: {r.id: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert get([(5, 1), (1, 4), (9, 8), (4, 1)]) == {1: 1, 4: 1, 5: 1, 8: 8, 9: 8} and not steps
    assert get([(1, 2), (2, 3), (3, 4), (4, 5)]) == dict.fromkeys(range(1, 6), 1) and steps
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(250)]
    want = list(range(300))
    for _ in range(300):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert get(links) == {k: want[k] for a, b in links if a != b for k in (a, b)}
