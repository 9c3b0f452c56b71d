"""Token ids in patched frame-of-reference blocks.

The file format is a Parquet data set of segments. A segment holds the ids of whole documents, in ascending ``doc_id``
order over all shards: ``payload`` is a header (count and number of blocks), the block index (minimum, width, exceptions and byte
offset of each block) and the blocks. A block of BLOCK ids has its minimum subtracted and is packed at the width that
PERCENT of its values need; the others are exceptions, kept as (position, value) lists. Spark's commit protocol makes the
files whole even if executors are lost.

The tokenizers library encodes whole texts. Where the tokenizer's own rules never look across white space (``by_words``
reads them from its file), each distinct white-space separated word is encoded once per Python worker, and a text's ids are
those of its words in order; any other tokenizer gets the texts as they are. Null is an empty text and only gets the end id.
Rows with equal ids are ordered by text hash and dealt over several ranges; null ids come first. An empty table gives no
segments and an empty result; other columns play no part.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratus.llm.common import chunks, documents, new_path, parts, utf8

#: Ids of a block, percentage of them that the width must hold, ids of a segment at least, words that a worker remembers, new words that the library gets at a time, threads of the library in a task.
BLOCK, PERCENT, SEGMENT, MEMO, AT_ONCE, THREADS = 1024, 95, 1_000_000, 1_000_000, 500, 2
END_ID = 1
#: Stops at the end of a word that have a letter or digit before them.
_STOPS = {b" " + s: re.compile(re.escape(s) + rb"(?<=[a-z0-9].)(?!\S)") for s in (b".", b",")}
_INDEX = np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("offset", "<u8")])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    wide = np.dtype("<u2") if width <= 16 else np.dtype("<u4")
    if width == 8 * wide.itemsize:
        return values.astype(wide).view(np.uint8).reshape(len(values), -1)
    bits = np.unpackbits(values.astype(wide).view(np.uint8).reshape(*values.shape, wide.itemsize), axis=-1, bitorder="little")[..., :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    wide = np.dtype("<u2") if width <= 16 else np.dtype("<u4")
    if width == 8 * wide.itemsize:
        return np.ascontiguousarray(packed).view(wide).astype(np.uint32)
    bits = np.zeros((len(packed), BLOCK, wide.itemsize * 8), np.uint8)
    bits[..., :width] = np.unpackbits(packed, axis=1, bitorder="little", count=BLOCK * width).reshape(len(packed), BLOCK, width)
    return np.packbits(bits, axis=-1, bitorder="little").reshape(len(packed), -1).view(wide).astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> bytes:
    """Header, block index and blocks of ids below 2**32."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = np.array([n, blocks], "<u8").tobytes()
    if not n:
        return head
    padded = np.full(blocks * BLOCK, ids[-1], np.uint32)
    padded[:n] = ids
    rows = padded.reshape(blocks, BLOCK)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    mark = np.partition(rest, BLOCK * PERCENT // 100 - 1, axis=1)[:, BLOCK * PERCENT // 100 - 1]
    width = np.ceil(np.log2(mark.astype(np.float64) + 1)).astype(np.uint8)
    over = rest.astype(np.uint64) >> width[:, None] > 0
    count = over.sum(axis=1)
    rest_low = np.where(over, 0, rest)
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        packed = _pack(rest_low[at], int(w)) if w else np.zeros((len(at), 0), np.uint8)
        for k, row in zip(at.tolist(), packed, strict=True):
            bodies[k] = row.tobytes()
    for k in np.flatnonzero(count).tolist():
        where = np.flatnonzero(over[k])
        bodies[k] += where.astype("<u2").tobytes() + rest[k][where].astype("<u4").tobytes()
    index = np.zeros(blocks, _INDEX)
    index["least"], index["width"], index["exceptions"] = least, width, count
    index["offset"] = np.concatenate([[0], np.cumsum([len(b) for b in bodies])[:-1]])
    return head + index.tobytes() + b"".join(bodies)


def decode_blocks(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (all by default), found through the index."""
    n, blocks = np.frombuffer(payload, "<u8", 2).astype(np.int64)
    index = np.frombuffer(payload, _INDEX, blocks, 16)
    base = 16 + blocks * _INDEX.itemsize
    last = blocks if last is None else min(last, blocks)
    index = index[first:last]
    out = np.zeros((len(index), BLOCK), np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    for w in np.unique(index["width"]):
        at = np.flatnonzero(index["width"] == w)
        if w:
            size = BLOCK * int(w) // 8
            out[at] = _unpack(raw[base + index["offset"][at].astype(np.int64)[:, None] + np.arange(size)], int(w))
    for k in np.flatnonzero(index["exceptions"]).tolist():
        x, c = index[k], int(index["exceptions"][k])
        p = base + int(x["offset"]) + BLOCK * int(x["width"]) // 8
        out[k, np.frombuffer(payload, "<u2", c, p)] = np.frombuffer(payload, "<u4", c, p + 2 * c)
    out += index["least"][:, None]
    return out.reshape(-1)[: max(0, n - first * BLOCK)]


#: What this worker has encoded so far, by tokenizer file.
_memos: dict[str, dict[bytes, bytes]] = {}


def by_words(path: str) -> bool:
    """Whether the tokenizer in ``path`` drops white space and treats what it separates on its own.

    Its normaliser may only compose characters (NFC), change case and replace white space; its pre-tokenizer has to keep the
    matches of one pattern that can't hold white space; no added token may have any.
    """
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    flat = lambda x, key: [] if x is None else [y for z in x[key] for y in flat(z, key)] if x["type"] == "Sequence" else [x]
    for n in flat(rules["normalizer"], "normalizers"):
        if n["type"] not in ("NFC", "Lowercase") and not (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "):
            return False
    split, *rest = flat(rules["pre_tokenizer"], "pretokenizers") or [{"type": ""}]
    if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"] or any(x["type"] != "ByteLevel" or x["add_prefix_space"] or x["use_regex"] for x in rest):
        return False
    pattern = split["pattern"].get("Regex", " ").replace(r"[^\s", "[^")
    odd = re.search(r"\s|\\[^pP]|\.|\[\^(?!\\p\{L\}\\p\{N\}\])|\(\?", pattern)
    return not odd and split["pattern"]["Regex"].count("[^") == split["pattern"]["Regex"].count(r"[^\s") and not any(re.search(r"\s", t["content"]) for t in rules["added_tokens"])


def encoder(path: str, threads: int = THREADS):
    """A function from UTF-8 texts to their ids as little-endian uint32 bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    from tokenizers import Tokenizer

    tokenizer, memo = Tokenizer.from_file(path), _memos.setdefault(path, {})

    def library(texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def separate(base: list[bytes]) -> Iterator[bytes]:
        """Ids of each of the words, which the library gets AT_ONCE of in a text; the characters that ids stand for tell the words apart."""
        groups = [[w.decode() for w in base[k : k + AT_ONCE]] for k in range(0, len(base), AT_ONCE)]
        for ws, e in zip(groups, tokenizer.encode_batch([" ".join(ws) for ws in groups], add_special_tokens=False), strict=True):
            ids, first = np.array(e.ids, "<u4").tobytes(), np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            ends = np.cumsum([len(w) + 1 for w in ws])
            at = [0, *(4 * np.searchsorted(first, ends)).tolist()]
            yield from (ids[a:b] for a, b in itertools.pairwise(at))

    added = [t.content.encode().lower() for t in tokenizer.get_added_tokens_decoder().values()]
    stops = {c + s for c in "abcdefghijklmnopqrstuvwxyz0123456789" for s in ".,"}
    apart = by_words(path) and tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("A") == "a" and all(len(tokenizer.pre_tokenizer.pre_tokenize_str(x)) == 2 for x in stops)

    def cut(text: bytes) -> list[bytes]:
        """The text's words; where the tokenizer does so as well, in lower case and with final stops apart."""
        low = text.lower()
        if not apart or any(t in low for t in added):
            return text.split()
        for cut_off, stop in _STOPS.items():
            low = stop.sub(cut_off, low)
        return low.split()

    def known(wanted: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words; what is new is remembered while there is room."""
        new = list(wanted.difference(memo))
        got = dict(zip(new, separate(new), strict=True))
        if len(memo) + len(got) <= MEMO:
            memo.update(got)
            return memo
        return {w: got[w] if w in got else memo[w] for w in wanted}

    def words(texts: list[bytes]) -> list[bytes]:
        found = [cut(t) for t in texts]
        ids = known(set().union(*found))
        return [b"".join(map(ids.__getitem__, ws)) for ws in found]

    return words if by_words(path) else library


_SEGMENT = "shard int, segment long, start long, doc_ids array<long>, n_tokens array<long>, payload binary"


def _write(path: str, end_id: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        docs: list[int | None] = []

        def put() -> pa.RecordBatch:
            sizes = [len(x) // 4 for x in ids]
            payload = encode_blocks(np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment]), "start": pa.array([start]), "doc_ids": pa.array([docs], pa.list_(pa.int64())), "n_tokens": pa.array([sizes], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary())})

        held = 0
        for batch in batches:
            data, at = utf8(batch.column("text"))
            raw, names = data.tobytes(), batch.column("doc_id").to_pylist()
            for i, j in chunks(at):
                for k, got in zip(range(i, j), encode([raw[at[x] : at[x + 1]] for x in range(i, j)]), strict=True):
                    ids.append(got + end)
                    docs.append(names[k])
                    held += len(got) // 4 + 1
                    if held >= SEGMENT:
                        yield put()
                        segment, start, held = segment + 1, start + held, 0
                        ids.clear()
                        docs = []
        if docs:
            yield put()

    return f


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all texts and writes their segments below ``path``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(parts(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(_write(tokenizer, end_id), _SEGMENT).write.option("compression", "none").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids = decode_blocks(batch.column("payload")[row].as_buffer().to_pybytes()).astype("<u4")
            sizes = batch.column("n_tokens")[row].values.to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            raw = memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("shard")[row].as_py()] * len(sizes), pa.int32()), batch.column("doc_ids")[row].values, pa.array(at[:-1] + batch.column("start")[row].as_py()), pa.array(sizes), pa.array(crc, pa.int64())], ["shard", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, computed from the decoded ids."""
    files = spark.read.schema(_SEGMENT).parquet(path)
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = files.groupBy("shard").agg(F.sum(size).alias("n"))  # a row for each shard
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    found = files.mapInArrow(_read, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(base, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path)
