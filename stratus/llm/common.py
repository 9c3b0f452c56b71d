"""What the operators share: tables in the shared folder, Arrow batches as numpy, whole groups of sorted rows."""

from __future__ import annotations

import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass holds; a longer document is a pass of its own.
CHUNK_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Only a local session that has none gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.stratus.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="spark-stratus-")
            spark.conf.set("spark.stratus.dir", found)
    return found


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stratus-{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there, and a lost executor loses nothing."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables of :func:`saved` that no later step reads."""
    for df in tables:
        if path := getattr(df, "saved_at", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_key(df: DataFrame, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a key in one partition and next to each other."""
    return df.repartition(parts(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if offsets and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pieces(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of a batch in passes of bounded size."""
    data, at = utf8(batch.column(column))
    for i, j in chunks(at, most):
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from bytes and offsets."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data, np.uint8))]).cast(pa.binary())


def whole_groups(batches: Iterable[pa.RecordBatch], *keys: str, most: int = 64_000_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows are sorted by ``keys``) with the n + 1 bounds of the groups."""
    held: list[pa.RecordBatch] = []

    def split(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(len(table), bool)
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        bounds = np.concatenate([[0], starts, [len(table)]])
        held.clear()
        if not last:
            if len(bounds) > 2:
                cut = int(bounds[-2])
                held.extend(table.slice(cut).to_batches())
                yield table.slice(0, cut), bounds[:-1]
            else:
                held.extend(table.to_batches())
        elif len(table):
            yield table, bounds

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= min(most, 4_000_000):
            yield from split(False)
            size = sum(b.nbytes for b in held) // 2
    if held:
        yield from split(True)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser over uint64 values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Modulus of the substring hash, a Mersenne prime.
PRIME = 2**61 - 1
_P, _U = np.uint64(PRIME), np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Key of hashes that never leave one task.
OWN_KEY = secrets.randbits(60)


def new_key() -> int:
    """A secret key for the hashes of one run: texts written without knowing it cannot be made to collide."""
    return secrets.randbits(60)


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME."""
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of factors below it, from halves of 31 and 30 bits."""
    au, ad, bu, bd = a >> _U(31), a & _U(2**31 - 1), b >> _U(31), b & _U(2**31 - 1)
    mid = ad * bu + au * bd
    return _reduced(au * bu * _U(2) + (mid >> _U(30)) + ((mid & _U(2**30 - 1)) << _U(31)) + ad * bd)


def powers(n: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base that ``key`` stands for and of its inverse, modulo PRIME."""
    if key not in _powers or len(_powers[key][0]) < n:
        if len(_powers) > 1 and key not in _powers:
            _powers.clear()
        size, base = max(n, 1 << 20), 2**32 + key
        both = []
        for b in (base, pow(base, -1, PRIME)):
            out, have = np.ones(size, np.uint64), 1
            while have < size:
                more = min(have, size - have)
                out[have : have + more] = times(out[:more], np.full(1, pow(b, have, PRIME), np.uint64))
                have += more
            both.append(out)
        _powers[key] = both[0], both[1]
    return _powers[key][0][:n], _powers[key][1][:n]


def prefix_hash(data: np.ndarray, key: int) -> np.ndarray:
    """n + 1 prefix sums of byte times power modulo PRIME; a substring's hash comes from two of them."""
    up = powers(len(data) + 1, key)[0][:-1]
    byte = data.astype(np.uint64) + _U(1)
    # sums of 32 low and 29 high bits do not overflow below 2 ** 23 bytes, longer texts are summed in blocks
    block, out, carry = 1 << 22, np.zeros(len(data) + 1, np.uint64), _U(0)
    for i in range(0, len(data), block):
        b, u = byte[i : i + block], up[i : i + block]
        low, high = np.cumsum(b * (u & _U(2**32 - 1)), dtype=np.uint64), np.cumsum(b * (u >> _U(32)), dtype=np.uint64)
        high = high + (low >> _U(32))
        total = _reduced((high >> _U(29)) + ((high & _U(2**29 - 1)) << _U(32)) + (low & _U(2**32 - 1)) + carry)
        out[i + 1 : i + 1 + len(b)] = total
        carry = total[-1]
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """Equal for equal bytes; two different strings of n bytes agree for at most n in 2 ** 61 keys."""
    down = powers(len(prefix), key)[1]
    return mix(times(_reduced(prefix[end] + _P - prefix[start]), down[start]))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words ``[^\\x20\\x09-\\x0D]+``."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """The id of a row; without one a hash of its text from 2 ** 62 on, so such rows come last, and those of one text are repeated rows."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(plain_text(text_col)).bitwiseAND(2**62 - 1) + F.lit(2**62))


def plain_text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
