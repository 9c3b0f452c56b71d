"""Lines of a band that are alike but unlike the band's smallest line."""

import random

import pytest

from stratus.llm import line_dedup
from stratus.llm.components import components


def _family(r, size):
    """Lines of one template of 30 words with 5 open places, and one near copy (two words differ) of each."""
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    base, out = [word() for _ in range(30)], []
    for _ in range(size):
        line = list(base)
        for k in range(0, 30, 6):
            line[k] = word()
        out.append(" ".join(line))
        out.append(" ".join([*line[:-1], word()]))
    return out


@pytest.mark.parametrize("leaf", [line_dedup.LEAF, 4])
def test_all_pairs_of_a_band_are_compared(spark, leaf):
    texts = [x for seed in range(3) for x in _family(random.Random(seed), 20)]
    lines = line_dedup.lines_of(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    group = {r.id: r.component for r in components(line_dedup.line_links(lines, leaf=leaf)).collect()}
    ids = {r.doc_id: r.id for r in lines.collect()}
    sets = {k: set(t.split()) for k, t in enumerate(texts)}
    # at 29 common words of 31 a pair shares a band with probability 0.99999
    alike = [(k, k + 1) for k in range(0, len(texts), 2)]
    assert all(len(sets[a] & sets[b]) == 29 for a, b in alike)
    assert all(group.get(ids[a], ids[a]) == group.get(ids[b], ids[b]) for a, b in alike)
    assert len(set(group.values())) > 3  # the families do not become one by chance
