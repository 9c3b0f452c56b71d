"""Repair of conversations: the cheapest edits that make the roles read ``(system? (user assistant)+)?``.

Hirschberg's divide and conquer over four states (nothing yet, after system, user, assistant): forward and backward cost vectors meet in
the middle of the rows, the crossing with the least audit among the optimal ones is taken, and both halves are solved by themselves, so
only vectors of four numbers are held. An audit's left part consumes a fixed number of rows and ends with one, so no left part is a
prefix of another, and the least one decides. Before rows are cut into halves in a task, Spark cuts conversations into blocks, the
range partitions of (conversation, turn): each block gives a 4 x 4 matrix of costs, the matrices of a conversation (one for
each partition it spans) give the vector behind each block, all blocks are then solved by themselves from each state, and a last
walk over the blocks picks the states. So a conversation of any length is spread over many tasks; only its digest is taken
in one, row by row. Duplicates are found by the first place of each (role, text), aggregated before it is joined back.

Null role or text is one space, and so is a null conv_id or turn in the checksum that damages rows. Rows of one turn are ordered by role
and text; null turns come first. Rows without a conv_id are one conversation. Roles count by their first character; any other than s, u or a has to
be changed or deleted. Repeated rows are damaged alike. Extra columns play no part; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import by_key, parts, saved

#: Costs of changing a role, deleting, inserting, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 60
BLANK, DUPLICATE, CUT = 1, 2, 3
#: State after a row's role (system, user, assistant); after an inserted or changed row; what a kept role may follow.
_AFTER = {"s": 1, "u": 2, "a": 3}
_NEXT = (2, 2, 3, 2)
_FOLLOWS = {"s": (0,), "u": (0, 1, 3), "a": (2,)}
_ROLE = {2: "user", 3: "assistant"}
#: Inserted rows that bring each state to an end.
_TAIL = (0, 2, 1, 0)
Step = tuple[int, str, int]


def steps(state: int, role: str, fault: int) -> Iterator[Step]:
    """(cost, audit, state) of all ways to get over one row; rows are inserted before it."""
    for n in range(3):
        paid, done = INSERT * n, "I" * n
        yield paid + DELETE, done + "D", state
        if fault not in (BLANK, DUPLICATE):
            stays = paid + TRUNCATED * (fault == CUT)
            if state in _FOLLOWS.get(role, ()):
                yield stays, done + "K", _AFTER[role]
            yield stays + REROLE, done + "R", _NEXT[state]
        state = _NEXT[state]


#: All steps by (role, fault) and state, the cheapest one for each (audit, next state).
_STEPS = {(r, f): tuple(tuple(steps(s, r, f)) for s in range(4)) for r in "sua?" for f in range(4)}
Row = tuple[str, int]


def forward(rows: list[Row], lo: int, hi: int, start: int) -> list[int]:
    cost = [FAR] * 4
    cost[start] = 0
    for row in rows[lo:hi]:
        new = [FAR] * 4
        for s, ways in enumerate(_STEPS[row]):
            if cost[s] < FAR:
                for c, _, t in ways:
                    if cost[s] + c < new[t]:
                        new[t] = cost[s] + c
        cost = new
    return cost


def backward(rows: list[Row], lo: int, hi: int, after: list[int]) -> list[int]:
    cost = list(after)
    for k in range(hi - 1, lo - 1, -1):
        cost = [min(c + cost[t] for c, _, t in ways) for ways in _STEPS[rows[k]]]
    return cost


def solve(rows: list[Row], lo: int, hi: int, start: int, after: list[int], out: list[str]) -> int:
    """Appends the least audit of the cheapest way over rows lo..hi from ``start`` to an end that costs ``after``; the state it ends in."""
    if hi - lo == 0:
        return start
    if hi - lo == 1:
        best = min(c + after[t] for c, _, t in _STEPS[rows[lo]][start])
        audit, state = min((a, t) for c, a, t in _STEPS[rows[lo]][start] if c + after[t] == best)
        out.append(audit)
        return state
    mid = (lo + hi) // 2
    left, right = forward(rows, lo, mid, start), backward(rows, mid, hi, after)
    best = min(a + b for a, b in zip(left, right, strict=True))
    # ways to a crossing that is not optimal cost more than best, so the left half never ends there
    crossing = solve(rows, lo, mid, start, [b if a + b == best else FAR for a, b in zip(left, right, strict=True)], out)
    return solve(rows, mid, hi, crossing, after, out)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text): the rows after damage, nulls as one space; conv is the id as text behind ``=``, empty if null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = conversations.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumns({"text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")), "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "kind")


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` in order: part and pos (range partition and place), fault (0, BLANK, DUPLICATE, CUT) and initial (s, u, a or ?)."""
    # the last column only deals out rows that are repeated very often
    ordered = rows.repartitionByRange(parts(rows.sparkSession), "conv", "turn", "role", "text", F.monotonically_increasing_id()).sortWithinPartitions("conv", "turn", "role", "text")
    ordered = saved(ordered.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}), "turns")
    ordered = ordered.withColumn("same", F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256))
    firsts = ordered.groupBy("conv", "same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(0)
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("?")
    return ordered.join(firsts, ["conv", "same"], "left").select("conv", "turn", "role", "text", "part", "pos", fault.alias("fault"), known.alias("initial"))


def _rows_of(codes: bytes) -> list[Row]:
    return [("sua?"[c // 4], c % 4) for c in codes]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows sorted by (conv, part, pos) as their codes and cost matrices."""
    key, codes = None, bytearray()

    def block() -> pa.RecordBatch:
        rows = _rows_of(bytes(codes))
        matrix = [c for s in range(4) for c in forward(rows, 0, len(rows), s)]
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([bytes(codes)], pa.binary()), pa.array([matrix], pa.list_(pa.int64()))], ["conv", "part", "codes", "matrix"])

    for batch in batches:
        for conv, part, code in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "code")), strict=True):
            if key != (conv, part):
                if key:
                    yield block()
                key, codes = (conv, part), bytearray()
            codes.append(code)
    if key:
        yield block()


def _together(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[str, list[tuple]]]:
    """Rows sorted by conv: each one with all of its rows, one for each block and state at most."""
    rows = ((conv, row) for batch in batches for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv", *columns)), strict=True))
    for conv, group in itertools.groupby(rows, lambda r: r[0]):
        yield conv, [tuple(r) for _, r in group]


def _batches(rows: Iterator[tuple], **columns: pa.DataType) -> Iterator[pa.RecordBatch]:
    for some in itertools.batched(rows, 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), columns.values(), strict=True)], list(columns))


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cost behind each block; blocks are sorted by (conv, part)."""

    def rows() -> Iterator[tuple]:
        for conv, blocks in _together(batches, "part", "matrix"):
            after, out = [INSERT * n if s else 0 for s, n in enumerate(_TAIL)], []
            for part, m in reversed(blocks):
                out.append((conv, part, after, part == blocks[0][0]))
                after = [min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4)]
            yield from out

    return _batches(rows(), conv=pa.string(), part=pa.int32(), after=pa.list_(pa.int64()), first=pa.bool_())


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and last state of each block from each state it may begin in."""
    for batch in batches:
        found = []
        for conv, part, codes, after, first in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "codes", "after", "first")), strict=True):
            rows = _rows_of(codes)
            for s in (0,) if first else range(4):
                audit: list[str] = []
                found.append((conv, part, s, solve(rows, 0, len(rows), s, after, audit), "".join(audit)))
        columns = list(zip(*found, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["conv", "part", "state", "next", "audit"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states in which blocks begin; rows are sorted by (conv, part)."""

    def rows() -> Iterator[tuple]:
        for conv, ways in _together(batches, "part", "state", "next"):
            state = 0
            for part, own in itertools.groupby(ways, lambda w: w[0]):
                yield conv, part, state
                state = {s: t for _, s, t in own}[state]

    return _batches(rows(), conv=pa.string(), part=pa.int32(), state=pa.int32())


class _Result:
    """One conversation, row by row."""

    def __init__(self, conv: str):
        self.conv, self.hash, self.state, self.audits, self.faults, self.illegal, self.cost = conv, hashlib.sha256(), 0, [], [0] * 4, 0, 0
        self.turns, self.first, self.turn, self.before, self.lines, self.ahead, self.at = 0, None, None, None, 0, "", 0

    def line(self, role: str, text: str) -> None:
        self.hash.update(b"\n" * (self.lines > 0) + f"{role}:{text}".encode())
        self.lines += 1

    def insert(self) -> None:
        self.state = _NEXT[self.state]
        self.cost += INSERT
        self.line(_ROLE[self.state], "")

    def row(self, turn: int | None, role: str, text: str, fault: int, initial: str) -> None:
        self.faults[fault] += 1
        if turn is not None and turn != self.turn:
            self.turns, self.turn, self.first = self.turns + 1, turn, turn if self.first is None else self.first
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        while self.ahead[self.at] == "I":
            self.insert()
            self.at += 1
        edit = self.ahead[self.at]
        self.at += 1
        self.cost += {"K": 0, "R": REROLE, "D": DELETE}[edit] + TRUNCATED * (edit != "D" and fault == CUT)
        if edit != "D":
            self.state = _AFTER[initial] if edit == "K" else _NEXT[self.state]
            self.line(role if edit == "K" else _ROLE[self.state], text)

    def done(self) -> tuple:
        tail = _TAIL[self.state]
        for _ in range(tail):
            self.insert()
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audits) + "I" * tail, self.hash.hexdigest()


_REPAIRED = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv, part, pos), before each block its audit, as one row per conversation."""
    names = [c.split()[0] for c in _REPAIRED.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in _REPAIRED.split(", ")]
    now: _Result | None = None
    for batch in batches:
        out = []
        for conv, turn, role, text, fault, initial, audit in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "fault", "initial", "audit")), strict=True):
            if now is None or now.conv != conv:
                if now:
                    out.append(now.done())
                now = _Result(conv)
            if audit is not None:
                now.audits.append(audit)
                now.ahead, now.at = audit, 0
            elif fault is not None:
                now.row(turn, role, text, fault, initial)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.done(), types, strict=True)], names)


def repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = conversations.schema["conv_id"].dataType
    if damage:
        rows = damaged(conversations)
    else:
        space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        rows = conversations.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    rows = saved(judged(rows), "judged")
    code = F.expr("instr('sua?', initial) - 1") * 4 + F.col("fault")
    slim = by_key(rows.select("conv", "part", "pos", code.cast("int").alias("code")), "conv", "part", order=("pos",))
    blocks = saved(slim.mapInArrow(_matrices, "conv string, part int, codes binary, matrix array<long>"), "blocks")
    behind = by_key(blocks.select("conv", "part", "matrix"), "conv", order=("part",)).mapInArrow(_behind, "conv string, part int, after array<long>, first boolean")
    solved = saved(blocks.drop("matrix").join(behind, ["conv", "part"]).mapInArrow(_solved, "conv string, part int, state int, next int, audit string"), "solved")
    walk = by_key(solved.drop("audit"), "conv", order=("part",)).mapInArrow(_walk, "conv string, part int, state int")
    audits = solved.join(walk, ["conv", "part", "state"]).select("conv", "part", F.lit(-1).cast("long").alias("pos"), "audit")
    every = conversations.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")).distinct().select("conv", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("pos"))
    stream = rows.unionByName(audits, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    out = by_key(stream, "conv", order=("part", "pos")).mapInArrow(_repaired, _REPAIRED)
    return out.select(F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).cast(kind).alias("conv_id"), *out.columns[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
