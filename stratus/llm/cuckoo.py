"""Exact deduplication over a cuckoo-filter index of live digests.

The index has two growing tables in the shared folder. ``ledger`` (shard, digest, length, check, doc_id, n) counts the live
documents of each digest: 1 for each row that came, less what was deleted. ``filters`` (shard, version, n_buckets, table) has
one cuckoo filter of 16-bit fingerprints a shard, and a new version only of shards that changed. Digests of a batch are
pre-aggregated and meet the filter of their shard. What the filter doesn't know is new and goes in at once; only hits are
verified against the ledger, and those that turn out false go in as well. A filter without room is built anew, at twice the
size, from the live keys of its shard. A delete takes away one document for each row it is given; a fingerprint goes when its
last document does, so other copies stay live.

A hit is verified by SHA-256, length and a second hash of the normalised text, which stand for the content.

Null text counts as empty. Texts are equal when they are identical after every run of ``[\\x20\\x09-\\x0D]`` became one
space. Of equal texts the smallest ``doc_id`` stays; null ids sort last and repeated rows count each (all rows that carry
``keep_id`` are marked as kept). An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import by_key, documents, new_path, plain_text, saved, whole_groups

#: Digests that a shard of the index aims at.
SHARD_KEYS = 50_000
#: Slots of a bucket, moves before the table counts as full, share of slots that a new table fills.
SLOTS, MOVES, FILL = 4, 200, 0.8
#: A table is inserted in this many batches, one after the other.
BATCHES = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each has two buckets, either found from the other."""

    def __init__(self, n_buckets: int = 64, table: bytes | None = None):
        self.n = n_buckets
        self.slots = np.frombuffer(table, np.uint16).tolist() if table else [0] * (n_buckets * SLOTS)

    def _place(self, key: int) -> tuple[int, int, int]:
        mark = (key >> 48) % 65535 + 1
        a = key % self.n
        return mark, a, self._other(a, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (mark * 0x5BD1E995 - bucket) % self.n

    def contains(self, key: int) -> bool:
        mark, a, b = self._place(key)
        return mark in self.slots[a * SLOTS : a * SLOTS + SLOTS] or mark in self.slots[b * SLOTS : b * SLOTS + SLOTS]

    def insert(self, key: int) -> bool:
        """False if there was no room; the table is then to be built anew from the stored keys."""
        mark, a, b = self._place(key)
        for bucket in (a, b):
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.slots[s]:
                    self.slots[s] = mark
                    return True
        for move in range(MOVES):
            s = b * SLOTS + (mark + move) % SLOTS
            mark, self.slots[s] = self.slots[s], mark
            b = self._other(b, mark)
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.slots[s]:
                    self.slots[s] = mark
                    return True
        return False

    def delete(self, key: int) -> bool:
        mark, a, b = self._place(key)
        for bucket in (a, b):
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[s] == mark:
                    self.slots[s] = 0
                    return True
        return False

    @classmethod
    def of(cls, keys: list[int], n_buckets: int = 0) -> CuckooFilter:
        """A table with all ``keys``, at least ``n_buckets`` large and doubled until they fit."""
        n = max(n_buckets, 16, int(len(keys) / (SLOTS * FILL)) + 1)
        while True:
            made = cls(n)
            if all(map(made.insert, keys)):
                return made
            n *= 2

    def to_bytes(self) -> bytes:
        return np.array(self.slots, np.uint16).tobytes()


_KEY = ["shard", "digest", "length", "check"]
_KEYS = "shard int, digest string, length long, check long"
_FILTER = "shard int, version int, n_buckets long, table binary"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, length, check): SHA-256 of the normalised text, its length and a second hash."""
    text = F.regexp_replace(plain_text(text_col), r"[\x20\x09-\x0D]+", " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("long").alias("length"), F.xxhash64("t").alias("check"))


def _hashes(table: pa.Table) -> list[int]:
    return table.column("check").to_numpy().view(np.uint64).tolist()


def _probe(insert: bool):
    """Of one shard: each digest with what its filter says, and the filter with the unknown ones added (null if it is full)."""

    def f(rows: pa.Table, filters: pa.Table) -> pa.Table:
        keys = _hashes(rows)
        shard = (rows if len(rows) else filters).column("shard")[0].as_py()
        if len(filters):
            filt = CuckooFilter(filters.column("n_buckets")[0].as_py(), filters.column("table")[0].as_py())
            hits = list(map(filt.contains, keys))
            new = [k for k, h in zip(keys, hits, strict=True) if not h]
            full = insert and not all(map(filt.insert, new))
        else:
            filt, hits, new, full = CuckooFilter.of(keys if insert else []), [False] * len(keys), keys, False
        out = {**{c: rows.column(c).combine_chunks() for c in _KEY}, "hit": pa.array(hits, pa.bool_())}
        n = len(keys)
        if insert and new:
            out = {c: pa.concat_arrays([v, pa.array([shard] if c == "shard" else [None], v.type)]) for c, v in out.items()}
            n += 1
        last = bool(insert and new)
        out["version"] = pa.array([None] * len(keys) + [0] * last, pa.int32())
        out["n_buckets"] = pa.array([None] * len(keys) + [filt.n] * last, pa.int64())
        out["table"] = pa.array([None] * len(keys) + [None if full else filt.to_bytes()] * last, pa.binary())
        return pa.table(out)

    return f


def _changed(version: int, add: bool):
    """The filter of one shard with keys added or taken away; its table is null if it is full."""

    def f(rows: pa.Table, filters: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({"shard": pa.array([], pa.int32()), "version": pa.array([], pa.int32()), "n_buckets": pa.array([], pa.int64()), "table": pa.array([], pa.binary())})
        filt = CuckooFilter(filters.column("n_buckets")[0].as_py(), filters.column("table")[0].as_py())
        done = list(map(filt.insert if add else filt.delete, _hashes(rows)))
        full = add and not all(done)
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "version": pa.array([version], pa.int32()), "n_buckets": pa.array([filt.n]), "table": pa.array([None if full else filt.to_bytes()], pa.binary())})

    return f


def _rebuilt(version: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "shard"):
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                g = table.slice(i, j - i)
                filt = CuckooFilter.of(_hashes(g), 2 * g.column("n_buckets")[0].as_py())
                yield pa.RecordBatch.from_pydict({"shard": pa.array([g.column("shard")[0].as_py()], pa.int32()), "version": pa.array([version], pa.int32()), "n_buckets": pa.array([filt.n]), "table": pa.array([filt.to_bytes()], pa.binary())})

    return f


class CuckooIndex:
    """Live digests of documents. ``path`` is its folder; a second index on the same path goes on where the first one stopped."""

    def __init__(self, spark: SparkSession, expected_rows: int, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "cuckoo")
        self.shards = max(1, -(-expected_rows // SHARD_KEYS))
        self.version, self.deleted = 0, False
        #: Distinct digests that filters were asked for, and those of them that were verified, over all batches.
        self.probed = self.verified = 0
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/filters")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            last = self._filter_log().agg(F.max("version")).first()[0]
            self.version = last or 0
            self.shards = self.spark.read.parquet(f"{self.path}/shape").agg(F.max("shards")).first()[0]
            self.deleted = not self._ledger().where("n < 0").isEmpty()
        else:
            spark.createDataFrame([(self.shards,)], "shards int").coalesce(1).write.parquet(f"{self.path}/shape")

    def _ledger(self) -> DataFrame:
        return self.spark.read.schema(f"{_KEYS}, doc_id long, n long").parquet(f"{self.path}/ledger")

    def _filter_log(self) -> DataFrame:
        return self.spark.read.schema(_FILTER).parquet(f"{self.path}/filters")

    def _filters(self) -> DataFrame:
        """The last version of each shard's filter."""
        if not self.version:
            return self.spark.createDataFrame([], _FILTER)
        return self._filter_log().groupBy("shard").agg(F.max_by(F.struct("version", "n_buckets", "table"), "version").alias("f")).select("shard", "f.*")

    def _sharded(self, found: DataFrame) -> DataFrame:
        return found.select(F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int").alias("shard"), "digest", "length", "check", "doc_id")

    def _asked(self, keys: DataFrame, insert: bool) -> DataFrame:
        asked = keys.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInArrow(_probe(insert), f"{_KEYS}, hit boolean, version int, n_buckets long, table binary")
        out = saved(asked, "probe")
        self.probed += out.where("digest IS NOT NULL").count()
        self.verified += out.where("hit").count()
        return out

    def _put_filters(self, changed: DataFrame) -> None:
        """Appends new versions; full ones are built from the stored keys at twice the size."""
        changed = saved(changed.select("shard", "version", "n_buckets", "table"), "changed")
        changed.where("table IS NOT NULL").write.mode("append").parquet(f"{self.path}/filters")
        full = changed.where("table IS NULL").select("shard", "n_buckets")
        if not full.isEmpty():
            keys = self._live(self._ledger().join(full.select("shard"), "shard", "left_semi")).select("shard", "check").join(full, "shard")
            by_key(keys, "shard").mapInArrow(_rebuilt(self.version), _FILTER).write.mode("append").parquet(f"{self.path}/filters")

    def _live(self, ledger: DataFrame) -> DataFrame:
        """(key, keep_id, group_size) of the digests that have live documents."""
        if self.deleted:
            ledger = ledger.groupBy(*_KEY, "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
        return ledger.groupBy(*_KEY).agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))

    def insert(self, found: DataFrame) -> None:
        """Adds a batch of :func:`digests`."""
        rows = saved(self._sharded(found), "batch")
        asked = self._asked(rows.select(*_KEY).distinct(), insert=True)
        false_hits = None
        if self.version:
            hits = asked.where("hit").select(*_KEY)
            live = self._live(self._ledger().join(hits, _KEY, "left_semi"))
            false_hits = saved(hits.join(live, _KEY, "left_anti"), "false")
        self.version += 1
        rows.withColumn("n", F.lit(1).cast("long")).write.mode("append").parquet(f"{self.path}/ledger")
        self._put_filters(asked.where("version IS NOT NULL").withColumn("version", F.lit(self.version)))
        if false_hits is not None and not false_hits.isEmpty():
            self._change(false_hits, add=True)

    def _change(self, keys: DataFrame, add: bool) -> None:
        self.version += 1
        self._put_filters(keys.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInArrow(_changed(self.version, add), _FILTER))

    def delete(self, found: DataFrame) -> None:
        """Takes away one live document for each row (doc_id, digest) of a batch; those that aren't there do not matter."""
        if not self.version:
            return
        rows = self._sharded(found).groupBy(*_KEY, "doc_id").agg(F.count(F.lit(1)).alias("m"))
        hits = self._asked(rows.select(*_KEY).distinct(), insert=False).where("hit").select(*_KEY)
        there = self._ledger().join(hits, _KEY, "left_semi").groupBy(*_KEY, "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
        a, b = rows.alias("a"), there.alias("b")
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
        for c in _KEY:
            same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        gone = saved(a.join(b, same).select(*(f"a.{c}" for c in [*_KEY, "doc_id"]), (-F.least("m", "n")).alias("n")), "gone")
        gone.write.mode("append").parquet(f"{self.path}/ledger")
        self.deleted = True
        touched = gone.select(*_KEY).distinct()
        dead = saved(touched.join(self._live(self._ledger().join(touched, _KEY, "left_semi")), _KEY, "left_anti"), "dead")
        if not dead.isEmpty():
            self._change(dead, add=False)

    def lookup(self, found: DataFrame) -> DataFrame:
        """``found`` with keep_id and group_size of its live entry, null where there is none."""
        rows = self._sharded(found)
        hits = self._asked(rows.select(*_KEY).distinct(), insert=False).where("hit").select(*_KEY)
        live = self._live(self._ledger().join(hits, _KEY, "left_semi"))
        return rows.join(live, _KEY, "left").drop("shard")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = saved(digests(docs, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("doc_id", "check"), F.lit(batches))), "digests")
    index = CuckooIndex(docs.sparkSession, found.count())
    for b in range(batches):
        index.insert(found.where(F.col("batch") == b))
    kept = F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False))
    return index.lookup(found).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
"""
