"""The keyed substring hash against integers, and texts built to collide under sums modulo 2 ** 64."""

import numpy as np

from stratus.llm import crf_quality, near_dup, suffix_index
from stratus.llm.common import PRIME, mix, powers, prefix_hash, substring_hash


def _colliding(n=1024):
    """A word of a and b that counts ones in the binary index, and its complement."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_substring_hash_is_the_polynomial_modulo_the_prime():
    r = np.random.default_rng(1)
    data, key = r.integers(0, 256, 3000, dtype=np.uint8), 2**60 - 12345
    prefix, base = prefix_hash(data, key), 2**32 + key
    start = r.integers(0, 2900, 50)
    end = start + r.integers(0, 100, 50)
    want = [sum((int(data[i]) + 1) * pow(base, int(i - s), PRIME) for i in range(s, e)) % PRIME for s, e in zip(start, end, strict=True)]
    assert (substring_hash(prefix, start, end, key) == mix(np.array(want, np.uint64))).all()
    assert powers(5, key)[0].tolist() == [pow(base, i, PRIME) for i in range(5)]


def test_long_texts_are_summed_over_blocks():
    """Equal passages on both sides of the border of two blocks have one hash, under any key."""
    r = np.random.default_rng(2)
    data, piece = r.integers(0, 256, (1 << 22) + 5000, dtype=np.uint8), r.integers(0, 256, 1000, dtype=np.uint8)
    at = np.array([100, (1 << 22) - 500, (1 << 22) + 2000])
    for a in at:
        data[a : a + 1000] = piece
    for key in (0, 77, 2**60 - 1):
        assert len(set(substring_hash(prefix_hash(data, key), at, at + 1000, key).tolist())) == 1


def test_colliding_words_are_not_linked(spark):
    a, b = _colliding()
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_colliding_lines_are_not_repeated(spark):
    a, b = _colliding()
    data = np.frombuffer(f"{a}\n{b}\n{a}".encode(), np.uint8)
    assert crf_quality.line_features(data, np.array([0, len(data)]))["n_dup_lines"].tolist() == [1]


def test_colliding_windows_stay(spark):
    """Two texts whose only common 400 bytes would be the two words."""
    a, b = _colliding()
    rows = [(1, "x" + a), (2, "y" + b), (3, "z" + a)]
    got = {x.doc_id: x.n_removed for x in suffix_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batches=2).collect()}
    text = {k: t.encode() for k, t in rows}
    for k, t in text.items():
        starts = {s: [i for j in text for i in range(len(text[j]) - 399) if text[j][i : i + 400] == t[s : s + 400]] for s in range(len(t) - 399)}
        gone = {i for s, found in starts.items() if len(found) > 1 for i in range(s, s + 400)}
        assert got[k] == len(gone)
