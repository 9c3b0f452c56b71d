"""The class model: plain scores by counting, exact gains, probabilities that sum to one, and texts it has not seen."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stratus.llm import class_lm as cl
from stratus.llm.common import binary

SCHEMA = "doc_id long, text string, word string, id long, n long, `class` int, held string"


def _lower(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _texts():
    """Sentences of alternating kinds of words, so that the class of a word says much about the next one."""
    r = random.Random(7)
    kinds = [[f"{c}{k}" for k in range(60)] for c in "abcd"]
    out = []
    for _ in range(400):
        k, words = r.randrange(4), []
        for _ in range(r.randint(20, 60)):
            words.append(r.choice(kinds[k]))
            k = (k + 1) % 4 if r.random() < 0.95 else r.randrange(4)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    return [*_texts(), None, "", " \t\n", "ÀB ab AB", "never-seen " * 40, "x " * 30_000, "a0 b1", "a0 b1"]


@pytest.fixture(scope="module")
def rows(spark, texts):
    table = [(i, t, "w", 1, 2, 3, "h") for i, t in enumerate(texts)] + [(None, "a0 b0", "w", 1, 2, 3, "h"), (5, "c0", "w", 1, 2, 3, "h"), (5, "c0", "w", 1, 2, 3, "h")]
    return table, cl.score(spark.createDataFrame(table, SCHEMA).repartition(4)).collect()


def test_plain_scores_are_those_of_counting(rows):
    table, got = rows
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = collections.Counter(w for i, t, *_ in table if not held(i) for w in [*_lower(t), " "])
    total, types = sum(counts.values()), len(counts)
    want = []
    for i, t, *_ in table:
        words = [*_lower(t), " "]
        want.append((str(i), held(i), len(words), sum(counts[w] > 0 for w in words), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in words), 5)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)


def test_classes_say_more_than_counts_on_unseen_texts(rows):
    _, got = rows
    held = [r for r in got if r.held_out and r.n_tokens > 10 and r.n_known == r.n_tokens]
    assert len(held) > 40
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > sum(r.base_score for r in held) / sum(r.n_tokens for r in held) + 0.3
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_exchange_raises_the_likelihood_and_finds_the_kinds(spark, texts):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string").withColumn("held_out", F.lit(False))
    words, key = cl.vocabulary(docs)
    coded = cl.saved(docs.mapInArrow(cl._coder(key), cl._CODED), "coded")
    top = words.where("n > 0").toArrow().sort_by("id")
    classes, m, history = cl.exchange(coded, top.column("id").to_numpy(), top.column("n").to_numpy(), 6)
    assert history[-2] > history[0] and abs(cl.likelihood(m) - max(history)) < 1e-6
    assert m[: cl.CLASSES, : cl.CLASSES].sum() == sum(len(t.split()) + 1 for t in _texts())
    name = dict(zip(top.column("id").to_pylist(), classes.tolist(), strict=True))
    kind = collections.defaultdict(collections.Counter)
    for c in "abcd":
        for d in cl.digests(pa.array([f"{c}{k}".encode() for k in range(60)], pa.binary()), key).tolist():
            kind[name[d]][c] += 1
    assert sum(max(k.values()) for k in kind.values()) > 200


def test_gain_is_the_change_of_the_likelihood():
    r = np.random.default_rng(1)
    v, k = 40, cl.CLASSES
    pairs = r.integers(0, 6, (v, v)) * (r.random((v, v)) < 0.4)
    np.fill_diagonal(pairs, 0)
    classes = r.integers(0, k, v)

    def matrix(classes):
        m = np.zeros((k + 1, k + 1))
        np.add.at(m, (classes[:, None].repeat(v, 1), classes[None].repeat(v, 0)), pairs)
        return m

    m = matrix(classes)
    for w in range(v):
        to = int(r.integers(0, k))
        if to == classes[w]:
            continue
        counts = np.concatenate([np.bincount(classes, pairs[:, w], k + 1), np.bincount(classes, pairs[w], k + 1)])[None]
        new = classes.copy()
        new[w] = to
        got = cl.gain(counts, classes[w : w + 1], np.array([to]), m)[0]
        assert abs(got - (cl.likelihood(matrix(new)) - cl.likelihood(m))) < 1e-6


def test_transitions_sum_to_one():
    m = np.random.default_rng(2).integers(0, 4, (cl.CLASSES + 1, cl.CLASSES + 1)).astype(float)
    m[5] = m[-1] = m[:, -1] = 0  # no class before, and none of the unknown word among counted ones
    single = np.random.default_rng(3).random(cl.CLASSES + 1)
    p = cl.transitions(m, single / single.sum())
    assert np.allclose(p.sum(1), 1) and (p > 0).all()


def test_rows_of_a_word_become_one(spark):
    entries = cl._entries(np.eye(3, 2 * (cl.CLASSES + 1), dtype=np.int64) * 7)
    batches = [pa.RecordBatch.from_arrays([pa.array([1, 1, 2]), entries], ["id", "contexts"]), pa.RecordBatch.from_arrays([pa.array([2, 3, 3]), entries], ["id", "contexts"])]
    found = {}
    for b in cl._merged(batches):
        for ids, counts in cl._counts(b.column("id").to_numpy(), b.column("contexts")):
            for i, c in zip(ids.tolist(), counts, strict=True):
                assert i not in found
                found[i] = c[:3].tolist()
    assert found == {1: [7, 7, 0], 2: [7, 0, 7], 3: [0, 7, 7]}


def test_words_of_texts():
    data = "Ab cd\nab".encode() + b"" + b"zz Ab"
    words, number, at = cl.tokens(np.frombuffer(data, np.uint8), np.array([0, 8, 8, 13]))
    names = [words[int(i)].as_py() for i in number]
    assert names == [b"ab", b"cd", b"ab", b" ", b" ", b"zz", b"ab", b" "] and at.tolist() == [0, 4, 5, 8]
    assert binary(np.zeros(0, np.uint8), np.zeros(1, np.int64)).to_pylist() == []


def test_empty_and_all_held_out(spark):
    assert cl.score(spark.createDataFrame([], SCHEMA)).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = cl.score(spark.createDataFrame([(held, "a b", "w", 1, 2, 3, "h")], SCHEMA)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
