"""Later turns join components, not their lines once more; tables that no later step reads are deleted."""

import random
from pathlib import Path

from stratus.llm import common, line_dedup
from tests.llm.test_line_pairs import _family


def test_later_turns_join_components_and_leave_no_tables(spark, monkeypatch):
    name, calls, real = {}, [], line_dedup.components

    def joined(links):
        ends = {x for r in links.collect() for x in (r.u, r.v)}
        calls.append({x for x in ends if name.get(x, x) != x})
        out = real(links)
        new = {r.id: r.component for r in out.collect()}
        name.update({x: new.get(y, y) for x, y in {**{z: z for z in new}, **name}.items()})
        return out

    monkeypatch.setattr(line_dedup, "components", joined)
    monkeypatch.setattr(line_dedup, "ROWS", 1)  # bands with many lines, of which few are alike
    monkeypatch.setattr(line_dedup, "BANDS", 2)
    texts = [x for seed in range(2) for x in _family(random.Random(seed), 12)]
    lines = line_dedup.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    links = line_dedup.line_links(lines).collect()
    assert len(calls) > 1 and not any(calls)
    # each line once, under the name of its component, which is the smallest id of it
    group = {r.u: r.v for r in links}
    assert len(links) == len(group) and not set(group) & set(group.values()) and all(u > v for u, v in group.items())
    assert group == {x: y for x, y in name.items() if x != y}
    left = {p.name.split("-")[1] for p in folder.iterdir() if p.name not in before}
    assert not left & {"signs", "shared", "texts", "lines", "pairs", "placed", "rest", "found", "large", "new"}
