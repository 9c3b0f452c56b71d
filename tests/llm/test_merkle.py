"""Manifests against a tree built in plain Python."""

import hashlib
import itertools
import zlib

import pytest

from stratus.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, node string, part int, c0 string, path string"


def _digest(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def _leaf(row):
    doc, text, lang, source, n = row
    return _digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def _tree(leaves, fanout):
    """(root, for each leaf its levels of (siblings before, after))"""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for proof, k in zip(proofs, at, strict=True):
            run = runs[k // fanout]
            proof.append(("".join(run[: k % fanout]), "".join(run[k % fanout + 1 :])))
        nodes, at = [_digest(*r) for r in runs], [k // fanout for k in at]
    return nodes[0], proofs


def _expected(rows, fanout):
    key = lambda r: (r[3] is not None, (r[3] or "").encode())
    groups = [sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for _, g in itertools.groupby(sorted(rows, key=key), key)]
    trees = [_tree([_leaf(r) for r in g], fanout) for g in groups]
    root, upper = _tree([t[0] for t in trees], fanout)
    out = []
    for group, (subroot, proofs), above in zip(groups, trees, upper, strict=True):
        for row, proof in zip(group, proofs, strict=True):
            doc, text, *rest = row
            changed = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and text is not None
            node = _leaf((doc, "".join(c.lower() if c.isascii() else c for c in text), *rest)) if changed else _leaf(row)
            for before, after in proof + above:
                node = _digest(before, node, after)
            out.append((str(doc), _leaf(row), subroot, root, _digest(*(x for level in proof + above for x in level)), node, node == root))
    return sorted(out)


def _rows(sizes):
    out = []
    for s, n in sizes:
        out += [(k * 3 % 1000 + 1000 * len(out), ["Text É %d" % k, None, "", "lower"][k % 4], None if k % 5 else "en", s, None if k % 7 == 0 else k) for k in range(n)]
    return out


@pytest.mark.parametrize(("fanout", "sizes"), [(16, [(None, 40), ("", 1), ("a", 16), ("é", 17), ("b", 300)]), (2, [("x", 1), ("y", 5), (None, 2)]), (3, [("only", 10)]), (16, [("one", 1)]), (2, [(f"s{k:02}", 1 + k % 3) for k in range(20)])])
def test_manifest(spark, fanout, sizes):
    rows = _rows(sizes)
    if fanout == 16 and len(rows) > 9:
        rows += [(None, "no id", "en", None, 1), (3, "X" * 3_000_000, "en", "b", 1), rows[0], rows[0], (rows[0][0], "other text", "en", rows[0][3], 9)]
    df = spark.createDataFrame([(*r, "t", 7, "n", 8, "c", "p") for r in rows], SCHEMA).repartition(4)
    got = merkle.manifest(df, fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == _expected(rows, fanout)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
