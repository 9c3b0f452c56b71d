"""The parity sketch of a line rules out no pair that is alike."""

import random

from pyspark.sql import functions as F

from stratus.llm import line_dedup


def test_sketches_lose_no_pair(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9)))
    lines = ["x", "a b", "ab" * 900]
    for size in (3, 30, 400):
        for changes in range(6):
            base = [word() for _ in range(size)]
            lines.append(" ".join(base))
            for _ in range(changes):
                base[r.randrange(size)] = word()
            lines.append(" ".join(base) + r.choice(["", "."]))
    lines = sorted(set(lines))
    sets = [{t[k : k + 9] for k in range(max(1, len(t) - 8))} for t in lines]
    texts = line_dedup._sketched(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    assert {x.id: x.n for x in texts.collect()} == {k: len(s) for k, s in enumerate(sets)}
    a, b = (texts.select(*(F.col(c).alias(f"{p}{c}") for c in texts.columns)) for p in "ab")
    passed = {(x.aid, x.bid) for x in a.join(b, F.col("aid") < F.col("bid")).where(line_dedup._near(80, "a", "b")).collect()}
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(alike) > 5 and alike <= passed and len(passed) < len(sets) * (len(sets) - 1) // 4
