"""Brown class-based bigram model: exchange clustering puts words into classes; class transitions and word emissions score texts.

Words ``[^\\x20\\x09-\\x0D]+`` in lower case (A-Z only) and one end after each text are the tokens. Documents whose checksum of the
id leaves HELD modulo FOLDS are held out; all others are counted.

Words are told apart by 64-bit keyed BLAKE2b digests; the table of all words proves that no two share one (if so, another key is
drawn). Texts are coded once as passes of bounded size: the digests of a pass's words and each token's number among them.

Exchange clustering works on the core, the words with at least 1 / CORE of all counted tokens: at most CORE words at any size, so
their classes are a table of bounded size for every task. They begin in class rank modulo CLASSES. In each round all passes
give, for each core word, the counts of the classes before and after it; the words, dealt over the tasks, move to the class of most gain
under the class transitions of the round, if taking the word out of its class and putting it there raises the likelihood by itself.
A round that lowers the likelihood of the whole is taken back and ends the exchange. All other words are then put into the
class where their neighbours, counted in the same way, are likeliest. So every word has a class.

A text's probability is the product of P(class | class before) and P(word | class). Emissions and single classes add 1/2
to each count, and one class has the unknown word alone, so that they multiply to the plain model of ``base_score``; transitions
take an absolute discount and back off to single classes, the unknown word apart, which is as likely behind any class. A text begins as after an end.

Null and empty texts have the end as their only token. Rows without an id are counted, not held out. Repeated rows count each. Without counted
tokens both scores are 0. Extra columns play no part; an empty table gives an empty one.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import binary, by_key, documents, dropped, pieces, plain_text, saved, utf8

FOLDS, HELD = 5, 1
#: Classes (at most 120), least share of a core word as its inverse, most rounds of exchange, bytes of text in a pass.
CLASSES, CORE, ROUNDS, PASS_BYTES = 64, 1_000_000, 4, 8_000_000
#: Cells of a pass's words and contexts up to which they are counted in place.
DENSE = 1 << 23
#: Words whose contexts leave a task at once.
SLICE = 16_384
#: No word has a space, so this stands for the end.
END = b" "
_CONTEXT = np.dtype([("k", np.uint8), ("n", np.uint32)])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words of all texts and END last, number of each token among them, n + 1 bounds of the texts' tokens)."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = (lower != 32) & ((lower < 9) | (lower > 13))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts = np.flatnonzero(first)
    bounds = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)])
    coded = binary(lower[inside], bounds).dictionary_encode()
    n_words = np.diff(np.searchsorted(starts, offsets))
    at = np.concatenate([[0], np.cumsum(n_words + 1)])
    number = np.full(at[-1], len(coded.dictionary), np.int32)
    place = np.ones(at[-1], bool)
    place[at[1:] - 1] = False
    number[place] = coded.indices.to_numpy()
    return pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())]), number, at


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): counts of a pass's words in its counted texts, 0 for words of others."""
    for batch in batches:
        for rows, data, offsets in pieces(batch, "text"):  # Spark adds up a task's counts, so small passes do
            words, number, at = tokens(data, offsets)
            counted = np.repeat(~rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(number[counted], minlength=len(words)))], ["word", "n"])
            del words, number, counted
            pa.default_memory_pool().release_unused()


def digests(words: pa.Array, key: bytes) -> np.ndarray:
    joined = b"".join(hashlib.blake2b(w, digest_size=8, key=key).digest() for w in words.to_pylist())
    return np.frombuffer(joined, np.int64)


def vocabulary(rows: DataFrame) -> tuple[DataFrame, bytes]:
    """(id, n) for every word of ``rows`` (held_out, text), n in the counted ones, and the key of the digests."""
    counted = saved(rows.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    for attempt in range(8):
        key = b"stratus %d" % attempt

        def f(batches: Iterator[pa.RecordBatch], key: bytes = key) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(digests(batch.column("word"), key)), batch.column("n")], ["id", "n"])

        found = saved(counted.mapInArrow(f, "id long, n long"), "vocabulary")
        if found.groupBy("id").agg(F.count(F.lit(1)).alias("words")).where("words > 1").isEmpty():
            over(counted)
            return found, key
    raise RuntimeError("eight keys in a row gave two words one digest")


def packed(number: np.ndarray) -> bytes:
    return pa.compress(number.astype(np.int32).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.int32)


def _coder(key: bytes):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text", PASS_BYTES):
                words, number, at = tokens(data, offsets)
                docs = pa.array(rows.column("doc_id").to_pylist(), pa.int64())
                held = rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array([base + k]), pa.array([docs.to_pylist()], pa.list_(pa.int64())), pa.array([len(words)]), *(pa.array([x], pa.binary()) for x in (held.astype(np.uint8).tobytes(), at.astype(np.int64).tobytes(), digests(words, key).tobytes(), packed(number)))], ["pass", "doc_ids", "n_words", "held", "bounds", "ids", "tokens"])
                k += 1
                del words, number
                pa.default_memory_pool().release_unused()

    return f


_CODED = "pass long, doc_ids array<long>, n_words long, held binary, bounds binary, ids binary, tokens binary"


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of the words, counted tokens, the place of each one's text); every text is led by the end."""
    for batch in batches:
        for k in range(batch.num_rows):
            held, bounds, ids, number = (batch.column(c)[k].as_buffer() for c in ("held", "bounds", "ids", "tokens"))
            at = np.frombuffer(bounds, np.int64)
            number = unpacked(number, at[-1])
            counted = np.flatnonzero(np.frombuffer(held, np.uint8) == 0)
            sizes = np.diff(at)
            keep = np.repeat(np.frombuffer(held, np.uint8) == 0, sizes)
            ids = np.frombuffer(ids, np.int64)
            led = np.empty(keep.sum() + len(counted), np.int32)
            starts = np.concatenate([[0], np.cumsum(sizes[counted] + 1)])[:-1]
            place = np.ones(len(led), bool)
            place[starts] = False
            led[place], led[starts] = number[keep], len(ids) - 1
            yield ids, led, starts


def _classes_of(ids: np.ndarray, core: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, its place in ``core``); CLASSES and -1 for ids that are not in it."""
    if not len(core):
        return np.full(len(ids), CLASSES, np.uint8), np.full(len(ids), -1)
    at = np.minimum(np.searchsorted(core, ids), len(core) - 1)
    there = core[at] == ids
    return np.where(there, classes[at], CLASSES).astype(np.uint8), np.where(there, at, -1)


def _entries(counts: np.ndarray) -> pa.Array:
    """Rows of a matrix of counts as their cells over 0."""
    row, k = np.nonzero(counts)
    entries = np.empty(len(row), _CONTEXT)
    entries["k"], entries["n"] = k, counts[row, k]
    return binary(entries.view(np.uint8), np.searchsorted(row, np.arange(len(counts) + 1)) * _CONTEXT.itemsize)


def _contexts(of_core: bool, table):
    """For each word in (or not in) the core, how often each class stands before it (k) and after it (CLASSES + 1 + k) in a pass."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, classes = table.value
        width = 2 * (CLASSES + 1)
        for ids, led, starts in _passes(batches):
            kind, at = _classes_of(ids, core, classes)
            wanted = np.flatnonzero((at >= 0) == of_core)
            kind_of = np.int32 if len(wanted) * width < 2**31 else np.int64
            local = np.full(len(ids), -1, kind_of)
            local[wanted] = np.arange(len(wanted))
            word, own = local[led], kind[led]
            there = word >= 0
            there[starts] = False
            b = np.flatnonzero(there)
            before = word[b] * kind_of(width) + own[b - 1]
            there = word >= 0
            there[np.concatenate([starts[1:], [len(led)]])[: len(starts)] - 1] = False
            a = np.flatnonzero(there)
            del b, there
            cells = np.concatenate([before, word[a] * kind_of(width) + kind_of(CLASSES + 1) + own[a + 1]])
            del a, before, word, own
            if len(wanted) * width <= DENSE:
                dense = np.bincount(cells, minlength=len(wanted) * width)
                cell = np.flatnonzero(dense)
                n = dense[cell]
                del dense
            else:
                cell, n = np.unique(cells, return_counts=True)
            del cells
            entries = np.empty(len(cell), _CONTEXT)
            entries["k"], entries["n"] = cell % width, n
            word = cell // width
            del cell, n
            first = np.flatnonzero(np.diff(word, prepend=-1))
            ends, found = np.concatenate([first, [len(word)]]), ids[wanted][word[first]]
            for lo in range(0, max(len(first), 1), SLICE):
                own = ends[lo : lo + SLICE + 1]
                yield pa.RecordBatch.from_arrays([pa.array(found[lo : lo + SLICE]), binary(entries[own[0] : own[-1]].view(np.uint8), (own - own[0]) * _CONTEXT.itemsize)], ["id", "contexts"])

    return f


def _counts(ids: np.ndarray, contexts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, counts by context), some thousand rows at a time; rows of one id next to each other become one if they are in the same part."""
    width = 2 * (CLASSES + 1)
    for lo in range(0, len(ids), 8192):
        data, at = utf8(contexts.slice(lo, 8192))
        entries = np.frombuffer(data.tobytes(), _CONTEXT)
        own = ids[lo : lo + 8192]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        row = np.repeat(np.cumsum(new) - 1, np.diff(at) // _CONTEXT.itemsize)
        yield own[new], np.bincount(row * width + entries["k"], entries["n"], int(new.sum()) * width).reshape(-1, width)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by id as one for each id."""
    last: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        for ids, counts in _counts(batch.column("id").to_numpy(), batch.column("contexts")):
            if last is not None:
                if ids[0] == last[0][0]:
                    counts[0] += last[1][0]
                else:
                    ids, counts = np.concatenate([last[0], ids]), np.concatenate([last[1], counts])
            last = ids[-1:], counts[-1:]
            if len(ids) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(ids[:-1]), _entries(counts[:-1])], ["id", "contexts"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(last[0]), _entries(last[1])], ["id", "contexts"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(m: np.ndarray) -> float:
    """Log-likelihood of class transitions, without what does not depend on the classes."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum())


def likeliest(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class of most gain for each word by its contexts' ``counts``, to first order, under the transitions ``m``."""
    inner = np.log((m + 0.5) / (np.outer(m.sum(1), m.sum(0)) / max(m.sum(), 1.0) + 0.5))
    return (counts[:, : CLASSES + 1] @ inner[:, :CLASSES] + counts[:, CLASSES + 1 :] @ inner[:CLASSES].T).argmax(1)


def gain(counts: np.ndarray, own: np.ndarray, to: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rise of the likelihood when each word alone moves from class ``own`` to another one; a word that follows itself counts as two."""
    before, after = counts[:, : CLASSES + 1], counts[:, CLASSES + 1 :]
    row, col, each, out = m.sum(1), m.sum(0), np.arange(len(counts)), np.zeros(len(counts))
    change = lambda x, more: _xlogx(x + more) - _xlogx(x)
    for k, sign in ((to, 1), (own, -1)):
        cells = change(m[:, k].T, sign * before) + change(m[k], sign * after)
        cells[each, to] = cells[each, own] = 0.0
        out += cells.sum(1) - change(col[k], sign * before.sum(1)) - change(row[k], sign * after.sum(1))
    # the four cells between both classes change on both sides
    b_own, b_to, a_own, a_to = before[each, own], before[each, to], after[each, own], after[each, to]
    return out + change(m[own, own], -b_own - a_own) + change(m[own, to], b_own - a_to) + change(m[to, own], a_own - b_to) + change(m[to, to], b_to + a_to)


def _mover(table, m: np.ndarray):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, classes = table.value
        for batch in batches:
            for ids, counts in _counts(batch.column("id").to_numpy(), batch.column("contexts")):
                own = _classes_of(ids, core, classes)[0].astype(np.int64)
                best = likeliest(counts, m)
                some = np.flatnonzero((best != own) & (own < CLASSES))
                stay = some[gain(counts[some], own[some], best[some], m) <= 0]
                best[stay] = own[stay]
                n = counts[:, : CLASSES + 1].sum(1)  # each token has one before it
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(best.astype(np.int32))], ["id", "n", "class"])

    return f


def _transitions(table):
    """Class transitions among core words and the rest: the rest's row from what stands before core words."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, classes = table.value
        m = np.zeros((CLASSES + 1, CLASSES + 1))
        for batch in batches:
            for ids, counts in _counts(batch.column("id").to_numpy(), batch.column("contexts")):
                own = _classes_of(ids, core, classes)[0]
                for k in np.unique(own):
                    m[k] += counts[own == k, CLASSES + 1 :].sum(0)
                    m[CLASSES, k] += counts[own == k, CLASSES].sum()
        i, j = np.nonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(m[i, j].astype(np.int64))], ["i", "j", "n"])

    return f


def _matrix(cells: DataFrame, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for i, j, n in cells.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # at most size ** 2 rows
        out[i, j] = n
    return out


def over(*tables: DataFrame) -> None:
    """Deletes tables of a step that is over, and lets Spark delete its shuffle files, which it keeps while the driver holds its plan."""
    dropped(*tables)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def exchange(coded: DataFrame, core: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(classes of ``core``, transitions under them, likelihood after each round); ``core`` is sorted, ``counts`` are its words' counts."""
    spark = coded.sparkSession
    rank = np.empty(len(core), np.int64)
    rank[np.lexsort((core, -counts))] = np.arange(len(core))
    classes, best, history = (rank % CLASSES).astype(np.uint8), None, []
    for k in range(rounds + 1):
        table = spark.sparkContext.broadcast((core, classes))
        found = saved(by_key(coded.mapInArrow(_contexts(True, table), "id long, contexts binary"), "id").mapInArrow(_merged, "id long, contexts binary"), "contexts")
        m = _matrix(found.mapInArrow(_transitions(table), "i long, j long, n long"), CLASSES + 1)
        history.append(likelihood(m))
        if best is not None and history[-1] <= best[0]:
            break
        best = history[-1], classes, m
        if k == rounds:
            break
        moved = found.mapInArrow(_mover(table, m), "id long, n long, class int").toArrow()  # at most CORE rows
        order = np.argsort(moved.column("id").to_numpy())
        new = classes.copy()
        new[np.searchsorted(core, moved.column("id").to_numpy()[order])] = moved.column("class").to_numpy()[order]
        classes = new
        over(found)
    return best[1], best[2], history


def word_classes(coded: DataFrame, words: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, n, class) of every counted word."""
    known = words.where("n > 0")
    total = known.agg(F.sum("n")).first()[0] or 0
    top = known.where(F.col("n") * CORE >= total).toArrow().sort_by("id")  # at most CORE rows: each has 1 / CORE of all tokens
    core, counts = top.column("id").to_numpy(), top.column("n").to_numpy()
    if not len(core):
        return saved(known.withColumn("class", F.lit(0)), "classes")
    classes, m, _ = exchange(coded, core, counts, rounds)
    table = coded.sparkSession.sparkContext.broadcast((core, classes))
    rest = by_key(coded.mapInArrow(_contexts(False, table), "id long, contexts binary"), "id").mapInArrow(_merged, "id long, contexts binary").mapInArrow(_mover(table, m), "id long, n long, class int")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at = _classes_of(batch.column("id").to_numpy(), *table.value)
            keep = at >= 0
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("id").to_numpy()[keep]), pa.array(batch.column("n").to_numpy()[keep]), pa.array(own[keep].astype(np.int32))], ["id", "n", "class"])

    return saved(known.select("id", "n").mapInArrow(f, "id long, n long, class int").unionByName(rest), "classes")


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pass, local, id) of every pass's words."""
    for batch in batches:
        for k, ids in zip(batch.column("pass").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["pass", "local", "id"])


_EMITTED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary"


def _emitter(total: int, types: int, class_n: np.ndarray, class_types: np.ndarray):
    """Joins a pass with the counts and classes of its words: the texts' plain scores, emissions and class sequences."""

    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        local = right.column("local").to_numpy()
        for row in left.to_pylist():
            n, kind = np.zeros(row["n_words"], np.int64), np.full(row["n_words"], CLASSES, np.int64)
            n[local], kind[local] = right.column("n").to_numpy(), right.column("class").to_numpy()
            plain = np.log10((n + 0.5) / (total + 0.5 * (types + 1)))
            emit = np.log10((n + 0.5) / (class_n[kind] + 0.5 * class_types[kind]))
            at = np.frombuffer(row["bounds"], np.int64)
            number = unpacked(row["tokens"], at[-1])
            sums = [np.add.reduceat(x[number], at[:-1]) for x in (plain, emit, (n > 0).astype(np.int64))]
            out.append(pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(np.frombuffer(row["held"], np.uint8) == 1), "n_tokens": pa.array(np.diff(at)), "n_known": pa.array(sums[2]), "base_score": pa.array(sums[0]), "emitted": pa.array(sums[1]), "classes": binary(kind[number].astype(np.uint8), at)}))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("emitted", pa.float64()), ("classes", pa.binary())]).empty_table()

    return f


def _pairs(data: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """For each token its class and the one before it, the end's at the start of a text, as one number."""
    before = np.empty(len(data), np.int64)
    before[1:] = data[:-1]
    before[at[:-1]] = end
    return before * (CLASSES + 1) + data


def _counted_pairs(end: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 1) ** 2, np.int64)
        for batch in batches:
            data, at = utf8(batch.column("classes"))
            keep = np.repeat(~batch.column("held_out").to_numpy(zero_copy_only=False), np.diff(at))
            total += np.bincount(_pairs(data, at, end)[keep], minlength=len(total)) if len(data) else 0
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there // (CLASSES + 1)), pa.array(there % (CLASSES + 1)), pa.array(total[there])], ["i", "j", "n"])

    return f


def transitions(m: np.ndarray, single: np.ndarray) -> np.ndarray:
    """P(class | class before): counts less an absolute discount, the rest of each row by the single classes' probabilities.

    The last class, of the unknown word, has its single probability behind every class; the others share what is left.
    """
    once, twice = (m == 1).sum(), (m == 2).sum()
    discount = once / (once + 2 * twice) if once and twice else 0.5
    row = m.sum(1, keepdims=True)
    rest = np.where(row > 0, discount * (m > 0).sum(1, keepdims=True) / np.maximum(row, 1), 1.0)
    known = np.append(single[:-1] / max(single[:-1].sum(), 1e-300), 0.0)
    out = (1 - single[-1]) * (np.maximum(m - discount, 0) / np.maximum(row, 1) + rest * known)
    out[:, -1] = single[-1]
    return out


def _scorer(p: np.ndarray, end: int, total: int):
    with np.errstate(divide="ignore"):  # classes without words
        log = np.log10(p).reshape(-1)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("classes"))
            score = batch.column("emitted").to_numpy()
            if len(data):
                score = score + np.add.reduceat(log[_pairs(data, at, end)], at[:-1])
            n = batch.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(len(n), total)), batch.column("base_score"), pa.array(score), pa.array(10 ** np.minimum(-score / np.maximum(n, 1), 300))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return f


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), plain_text().alias("text"))
    words, key = vocabulary(rows)
    coded = saved(rows.mapInArrow(_coder(key), _CODED), "coded")
    classes = word_classes(coded, words, rounds)
    over(words)
    class_n, class_types = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for k, n, types in classes.groupBy("class").agg(F.sum("n"), F.count(F.lit(1))).collect():  # one row a class
        class_n[k], class_types[k] = n, types
    total, types = int(class_n.sum()), int(class_types.sum())
    class_types[CLASSES] = 1  # the unknown word
    found = coded.select("pass", "ids").mapInArrow(_numbers, "pass long, local int, id long").join(classes, "id").drop("id")
    emitted = saved(coded.drop("ids").groupBy("pass").cogroup(found.groupBy("pass")).applyInArrow(_emitter(total, types, class_n, class_types), _EMITTED), "emitted")
    over(coded)
    ends = classes.where(F.col("id") == int(digests(pa.array([END]), key)[0])).select("class").first()
    end = CLASSES if ends is None else ends[0]
    m = _matrix(emitted.select("held_out", "classes").mapInArrow(_counted_pairs(end), "i long, j long, n long"), CLASSES + 1)
    single = (class_n + 0.5 * class_types) / (total + 0.5 * (types + 1))
    return emitted.mapInArrow(_scorer(transitions(m, single), end, total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
