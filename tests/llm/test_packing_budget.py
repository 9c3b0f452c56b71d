"""The token budget is a boundary: only longer documents are over it, each in a batch of its own."""

import collections
import itertools

import numpy as np
import pytest

from stratus.llm import packing

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("buckets", [1, 3])
def test_documents_within_the_budget_stay_within_it(spark, buckets):
    rows = [(k, "word " * n) for k, n in enumerate([30, 40, 40, 200, 260, 5, 0, 99, 30])]
    got = packing.pack(spark.createDataFrame([*rows, (None, None)], "doc_id long, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, buckets, 100).collect()
    assert len(got) == len(rows) + 1
    batches = collections.defaultdict(list)
    for r in got:
        batches[r.batch].append(r)
        assert r.over_budget == (r.n_tokens > 100) == (r.bucket_length > 100)
        assert r.padding == r.bucket_length - r.n_tokens >= 0
    assert sum(r.over_budget for r in got) == 2
    assert all(len(b) == 1 if b[0].over_budget else len(b) * b[0].bucket_length <= 100 for b in batches.values())


@pytest.mark.parametrize("budget", [3, 10, 19])
def test_boundaries_respect_the_budget_and_are_optimal(budget):
    r = np.random.default_rng(budget)
    for _ in range(40):
        x = np.unique(r.integers(1, 20, 7))
        c = r.integers(1, 9, len(x))
        k = int(r.integers(2, 5))
        cost = lambda b, x=x, c=c: sum(int(n) * min(t for t in b if t >= v) for v, n in zip(x.tolist(), c, strict=True))
        legal = [b for m in range(1, k + 1) for b in itertools.combinations(x.tolist(), m) if b[-1] == x[-1] and (x[-1] <= budget or x[0] > budget or max(v for v in x.tolist() if v <= budget) in b)]
        got = packing.boundaries(x, c, k, budget)
        assert tuple(got) in legal and cost(got) == min(map(cost, legal))
