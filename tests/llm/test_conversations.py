"""Conversation repair against all edits of short conversations and against whole tables in plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratus.llm import conversations as co

SCHEMA = "conv_id long, turn long, role string, text string, part int, codes string, audit string"
INSERTS = [p for n in range(3) for p in itertools.product("ua", repeat=n)]


def _all_edits(rows):
    """(cost, audit, lines) of every way to edit ``rows`` (role, text, fault) with at most two insertions in a place; exponential."""
    best = None
    ways = []
    for role, text, fault in rows:
        own = [(co.DELETE, "D", "", None)]
        if fault not in (co.BLANK, co.DUPLICATE):
            more = co.TRUNCATED * (fault == co.CUT)
            own += [(more, "K", role[:1] or "?", (role, text))] + [(more + co.REROLE, "R", r[0], (r, text)) for r in ("user", "assistant")]
        ways.append([(c + 3 * len(p), "I" * len(p) + a, "".join(p) + r, [*(({"u": "user", "a": "assistant"}[x], "") for x in p), *([line] if line else [])]) for p in INSERTS for c, a, r, line in own])
    ends = [(3 * len(p), "I" * len(p), "".join(p), [({"u": "user", "a": "assistant"}[x], "") for x in p]) for p in INSERTS]
    for choice in itertools.product(*ways, ends):
        if re.fullmatch(r"(s?(ua)+)?", "".join(x[2] for x in choice)):
            got = (sum(x[0] for x in choice), "".join(x[1] for x in choice), [line for x in choice for line in x[3]])
            best = got if best is None or got[:2] < best[:2] else best
    return best


def _table(rows):
    """Least (cost, audit, lines) by a table over rows and states; no row is cut into halves."""
    best = {0: (0, "", [])}
    for role, text, fault in rows:
        new = {}
        for s, (cost, audit, lines) in best.items():
            for n in range(3):
                t, ins = s, []
                for _ in range(n):
                    t = 3 if t == 2 else 2
                    ins.append(("user" if t == 2 else "assistant", ""))
                options = [(4, "D", t, [])]
                if fault not in (1, 2):
                    more = 3 * (fault == 3)
                    k = role[:1]
                    if (k == "s" and t == 0) or (k == "u" and t != 2) or (k == "a" and t == 2):
                        options.append((more, "K", {"s": 1, "u": 2, "a": 3}[k], [(role, text)]))
                    r = 3 if t == 2 else 2
                    options.append((more + 3, "R", r, [("user" if r == 2 else "assistant", text)]))
                for c, a, state, line in options:
                    got = (cost + 3 * n + c, audit + "I" * n + a, lines + ins + line)
                    if state not in new or got[:2] < new[state][:2]:
                        new[state] = got
        best = new
    ends = []
    for s, (cost, audit, lines) in best.items():
        tail = {0: [], 1: [("user", ""), ("assistant", "")], 2: [("assistant", "")], 3: []}[s]
        ends.append((cost + 3 * len(tail), audit + "I" * len(tail), lines + tail))
    return min(ends, key=lambda x: x[:2])


def _faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = re.sub(r"[ \t-\r]", "", text)
        out.append(co.BLANK if not words else co.DUPLICATE if (role, text) in seen else co.CUT if words[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def _expected(table, solver):
    groups = {}
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        rows = groups.setdefault(conv, [])
        rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in rows if t is not None]
        fault = _faults([r[1:] for r in rows])
        initials = [r[1][:1] for r in rows]
        cost, audit, lines = solver([(r, t, f) for (_, r, t), f in zip(rows, fault, strict=True)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(k) for k in (1, 2, 3)), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, digest)
    return out


def _got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=3))
def test_halves_find_the_best_of_all_edits(rows):
    cost, audit, _ = _all_edits([(r, "x", f) for r, f in rows])
    codes = [(r[0] if r[0] in "sua" else "?", f) for r, f in rows]
    out = []
    end = co.solve(codes, 0, len(codes), 0, [3 * n for n in co._TAIL], out)
    assert "".join(out) + "I" * co._TAIL[end] == audit
    assert min(c + 3 * n for c, n in zip(co.forward(codes, 0, len(codes), 0), co._TAIL, strict=True)) == cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "u"]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=60))
def test_halves_find_what_a_table_finds(rows):
    _, audit, _ = _table([(r, "x", f) for r, f in rows])
    codes = [(r[0] if r[0] in "sua" else "?", f) for r, f in rows]
    out = []
    end = co.solve(codes, 0, len(codes), 0, [3 * n for n in co._TAIL], out)
    assert "".join(out) + "I" * co._TAIL[end] == audit


def _odd():
    r = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "a."), (7, None, "system", "s."), (7, None, "user", "q?"), (8, 5, "user", "same."), (8, 5, "user", "same."), (8, 900, "", "x"), (9, 0, "user", "é \n"), (10, 3, None, "y.")]
    rows += [(20 + k, t, r.choice(["system", "user", "assistant", "tool", None, "ubuntu"]), r.choice(["a.", "b!", "cut", " ", "", None, "z. \n"])) for k in range(120) for t in range(r.randint(1, 9))]
    rows += [(5000, k // 2, r.choice(["user", "assistant"]), r.choice(["a.", f"{k}?", "cut"])) for k in range(3000)]
    rows.append((5001, 0, "user", "long " * 400_000))
    return rows


def test_odd_rows(spark):
    """Nulls, one conversation over several blocks, a very long text, repeated rows, clashing columns."""
    rows = _odd()
    df = spark.createDataFrame([(*r, 1, "c", "a") for r in rows], SCHEMA).repartition(5)
    assert _got(co.repair(df)) == _expected(rows, _table)


def test_given_table(spark):
    path = "/root/testdata/sf0.01"
    table = pq.read_table(f"{path}/conversations.parquet").select(["conv_id", "turn", "role", "text"])
    assert _got(co.query(spark, path)) == _expected(list(zip(*(c.to_pylist() for c in table.columns), strict=True)), _table)


def test_empty_table(spark):
    assert co.repair(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("rows", [[("system", 0)], [("assistant", 0), ("user", 0)], [("user", 1)], []])
def test_small_cases(rows):
    codes = [(r[0], f) for r, f in rows]
    out = []
    end = co.solve(codes, 0, len(codes), 0, [3 * n for n in co._TAIL], out)
    assert "".join(out) + "I" * co._TAIL[end] == _all_edits([(r, "x", f) for r, f in rows])[1]
