"""Recall of the chosen-path trees at full depth, large groups of near copies, and rows that share an id."""

import random

from stratus.llm import near_dup


def _text(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def test_recall_at_full_depth(spark):
    """Families over one frequent passage, so that nodes stay large; pairs of similarity 0.86 to 0.9 in them."""
    r = random.Random(9)
    passage, rows = _text(r, 60), []
    for k in range(400):
        own = _text(r, 90)
        near = list(own)
        near[0] = "edited"
        near[-1] = "edited"
        rows += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join(passage + near))]
    found = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=32).collect()}
    assert sum(found[2 * k + 1] == 2 * k for k in range(400)) >= 0.9 * 400
    assert len(set(found.values())) >= 400
    assert near_dup.recall(0.85) > 0.99


def test_rows_of_one_id_are_told_apart(spark):
    r = random.Random(3)
    a, b = " ".join(_text(r, 80)), " ".join(_text(r, 80))
    docs = spark.createDataFrame([(5, a, 1), (5, b, 1), (3, b, 1), (None, a, 1), (None, "", 1), (7, None, 1)], "doc_id long, text string, comp int")
    got = sorted(((x.doc_id or 0), x.n_shingles, x.component_id or 0, x.kept) for x in near_dup.near_duplicates(docs).collect())
    assert got == [(0, 0, 0, False), (0, 76, 5, False), (3, 76, 3, True), (5, 76, 3, False), (5, 76, 5, True), (7, 0, 7, True)]
