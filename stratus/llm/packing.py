"""Optimal length buckets and padded token batches.

Texts are encoded with a byte-pair tokenizer. The global histogram of exact token counts gives bucket boundaries by dynamic
programming, so that padding every document to its bucket's boundary adds as few tokens as possible. Documents are
range-partitioned by (bucket, doc_id, text hash); each partition fills batches of ``budget // boundary`` documents (one at
least) of one bucket, so only the last batch of a bucket in each partition may stay short. A batch is a row of the written
data set: its documents' ids and true lengths, and a matrix of token ids padded to the boundary. The query reads the files
back.

The budget is a boundary between buckets. A document longer than it is a batch of its own and marked ``over_budget``; no other one is. Null and empty texts have no tokens and
are in the smallest bucket. Rows repeated under one id are packed each; rows without an id come last. Extra columns play no
part; an empty table gives an empty result. The histogram is one row for each distinct length, so it grows with the longest
text and not with the rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import chunks, documents, dropped, new_path, parts, saved, utf8

#: Buckets, tokens of a batch with padding.
BUCKETS, BUDGET = 16, 65_536
_BATCH = "bucket int, bucket_length long, batch long, over_budget boolean, doc_ids array<long>, n_tokens array<long>, tokens binary"


def splits(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[tuple[float, list[int]]]:
    """(padded length of all, upper bounds) with the least padding for one bucket, two, and so on, from the exact histogram.

    The best split of a longer prefix never lies before that of a shorter one, so each layer is solved by halving.
    """
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.int64), np.concatenate([[0], np.cumsum(counts[order])]).astype(np.int64)
    n = len(x)
    if not n:
        return []
    top = x.astype(np.float64)
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    back, found = [], []
    for _ in range(min(buckets, n)):
        new, split = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            a, b, lo, hi = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(lo, min(hi, j - 1) + 1)
            cost = best[i] + top[j - 1] * (c[j] - c[i])
            k = int(i[np.argmin(cost)])
            new[j], split[j] = cost.min(), k
            todo += [(a, j - 1, lo, k), (j + 1, b, k, hi)]
        back.append(split)
        best = new
        out, j = [], n
        for layer in reversed(back):
            if not j:
                break
            out.append(int(x[j - 1]))
            j = int(layer[j])
        found.append((float(best[n]), sorted(set(out))))
    return found


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS, budget: int | None = None) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding. No bucket has lengths on both sides of ``budget``; lengths on both take two buckets at least."""
    if budget is None or (lengths <= budget).all() or (lengths > budget).all():
        return splits(lengths, counts, buckets)[-1][1] if len(lengths) else []
    sides = [splits(lengths[side], counts[side], max(1, buckets - 1)) for side in (lengths <= budget, lengths > budget)]
    both = [(low[0] + high[0], low[1] + high[1]) for k, low in enumerate(sides[0], 1) for m, high in enumerate(sides[1], 1) if k + m <= max(2, buckets)]
    return min(both)[1]


def tokenizer(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks; ids from its size on are free."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _width(size: int) -> np.dtype:
    """Of an id: two bytes if the vocabulary and the padding id fit."""
    return np.dtype("<u2") if size < 2**16 else np.dtype("<u4")


def _encode(path: str, pattern: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(path, pattern)
        kind = _width(encoding.n_vocab)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            raw = data.tobytes()
            for i, j in chunks(at):
                ids = [np.array(encoding.encode_ordinary(raw[at[k] : at[k + 1]].decode()), kind) for k in range(i, j)]
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tie"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "tie", "n_tokens", "ids"])

    return f


def _fill(bounds: list[int], budget: int, pad: int):
    """Batches of the documents of a partition, which come sorted by bucket."""
    kind = _width(pad)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[bytes] = []
        docs: list[int | None] = []
        bucket = -1

        def put() -> pa.RecordBatch:
            sizes = np.array([len(x) // kind.itemsize for x in ids], np.int64)
            length = bounds[bucket]
            matrix = np.full((len(ids), length), pad, kind)
            for row, x in zip(matrix, ids, strict=True):
                row[: len(x) // kind.itemsize] = np.frombuffer(x, kind)
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "bucket_length": pa.array([length], pa.int64()), "batch": pa.array([number], pa.int64()), "over_budget": pa.array([length > budget]), "doc_ids": pa.array([docs], pa.list_(pa.int64())), "n_tokens": pa.array([sizes], pa.list_(pa.int64())), "tokens": pa.array([matrix.tobytes()], pa.binary())})

        for batch in batches:
            for b, doc, x in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if docs and (b != bucket or len(docs) >= max(1, budget // max(1, bounds[bucket]))):
                    yield put()
                    number += 1
                    ids, docs = [], []
                bucket = b
                ids.append(x)
                docs.append(doc)
        if docs:
            yield put()

    return f


def write_batches(docs: DataFrame, path: str, ranks: str, pattern: str, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all texts and writes their padded batches below ``path``; ``ranks`` and ``pattern`` are the tokenizer's."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    tokens = saved(rows.mapInArrow(_encode(ranks, pattern), "doc_id long, tie long, n_tokens long, ids binary"), "tokens")
    bars = tokens.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each distinct length
    bounds = boundaries(np.array([b[0] for b in bars], np.int64), np.array([b[1] for b in bars], np.int64), buckets, budget) or [0]
    bucket = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(bucket)
    order = ["bucket", F.coalesce("doc_id", F.lit(2**63 - 1)), "tie"]
    placed = tokens.select(bucket.alias("bucket"), "doc_id", "tie", "ids").repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    placed.select("bucket", "doc_id", "ids").mapInArrow(_fill(bounds, budget, tokenizer(ranks, pattern).n_vocab), _BATCH).write.option("compression", "zstd").parquet(path)
    dropped(tokens)


def _read(width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in batch.schema.names}
                sizes, length = one["n_tokens"].values.to_numpy(), one["bucket_length"].as_py()
                raw, n = one["tokens"].as_buffer(), len(sizes)
                crc = [zlib.crc32(raw[k * length * width : (k * length + size) * width]) for k, size in enumerate(sizes.tolist())]
                same = lambda c, kind, one=one, n=n: pa.array([one[c].as_py()] * n, kind)
                yield pa.RecordBatch.from_arrays(
                    [one["doc_ids"].values, pa.array(sizes), same("bucket", pa.int32()), same("bucket_length", pa.int64()), same("batch", pa.int64()), pa.array(np.arange(n)), pa.array(length - sizes), same("over_budget", pa.bool_()), pa.array(crc, pa.int64())],
                    ["doc_id", "n_tokens", "bucket", "bucket_length", "batch", "place", "padding", "over_budget", "ids_crc32"],
                )

    return f


def read_batches(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """One row per document of the files: its place, and the checksum of its ids as they are stored."""
    kind = "doc_id long, n_tokens long, bucket int, bucket_length long, batch long, place long, padding long, over_budget boolean, ids_crc32 long"
    return spark.read.schema(_BATCH).parquet(path).mapInArrow(_read(_width(vocabulary).itemsize), kind)


def pack(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, bucket_length, batch, place, padding, over_budget, ids_crc32."""
    if ranks is None:
        import public_tokenizers

        ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    path = new_path(docs.sparkSession, "batches")
    write_batches(docs, path, ranks, pattern, buckets, budget, id_col, text_col)
    return read_batches(docs.sparkSession, path, tokenizer(ranks, pattern).n_vocab)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
