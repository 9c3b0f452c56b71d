"""Removal of long repeated strings with a logarithmic family of sparse suffix arrays.

A text's anchors are the smallest hashed SEED-byte strings of its LENGTH-byte windows, the leftmost of equal ones. Equal
windows choose the same anchor, so suffixes at anchors are enough: an entry (head, seed, context, left, span) stands for
the ``span + 1`` windows that chose it; ``head`` holds the suffix's first bytes, and ``context`` the hash of all bytes that
those windows cover. A level is a sparse suffix array: its entries are range-partitioned and sorted by head, seed and context. A new
batch gets an array of its own, which is merged in that order with all live levels and scanned once: neighbours of one seed
and different contexts make the seed a candidate, also across partitions, where only the outermost entries are compared. Then
levels of equal size merge geometrically. Levels, anchors and candidates stay in the index's folder, so further batches can
be added later. Entries of equal contexts are one entry with a count, so groups of copies stay small.

Equal windows lie at the same distance before their anchor, so the windows of such seeds are compared by blocks of
distances, which shrink from step to step (WIDTHS). A block's core is what all of its windows cover: an entry whose core
no other entry has drops the block, blocks of equal bytes are repeated as a whole, and one block of each kind goes on to
the next step. Only counts of equal (seed, block) hashes decide, so no seed, passage or group of entries meets in one task; hashes are taken under a
secret key that the index keeps, modulo a prime, so texts cannot be built to collide.

Matches never cross documents. A byte goes if a LENGTH-byte string over it starts anywhere else as well; all strings are
judged on the input. Null is an empty text; texts under LENGTH bytes keep all. Two rows are the same only if id and text
are; repeated rows, with or without an id, repeat each other's text and so lose it. Extra columns play no part; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import binary, documents, dropped, mix, new_key, new_path, parts as n_parts, pieces, prefix_hash, saved, substring_hash

#: Bytes of a repeated string and of a seed, batches that are added one after the other.
LENGTH, SEED, BATCHES = 400, 32, 4
#: Distances in a block at each step; the last step compares single windows.
WIDTHS = (64, 8, 1)


def _smallest(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, from minima up to and from block borders."""
    n = len(values)
    padded = np.full(-(-n // w) * w, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _lots(data: np.ndarray, seed: int, key: int) -> np.ndarray:
    """Values of all seed-byte strings, of which windows choose the smallest. Equal strings of two values would be wrong, unequal ones of one value are not."""
    n, step = len(data) - seed + 1, min(8, seed)
    word = np.zeros(len(data) - step + 1, np.uint64)
    for j in range(step):
        word |= data[j : j + len(word)].astype(np.uint64) << np.uint64(8 * j)
    out = np.zeros(n, np.uint64)
    for j in {*range(0, seed - step + 1, step), seed - step}:
        out += word[j : j + n] * (mix(np.array([key + j], np.uint64)) | np.uint64(1))
    return mix(out)


def anchors(data: np.ndarray, offsets: np.ndarray, key: int, length: int = LENGTH, seed: int = SEED) -> dict[str, np.ndarray]:
    """Anchors of the documents in ``data``: document, position, first and last window start, seed, context and head."""
    n = len(data)
    start = np.arange(n - length + 1) if n >= length else np.zeros(0, np.int64)
    if len(start):
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        start = start[doc[: len(start)] == doc[length - 1 :]]
    if not len(start):
        return {k: np.zeros(0, np.int64) for k in ("doc", "pos", "lo", "hi", "seed", "context", "head")}
    prefix = prefix_hash(data, key)
    at = np.arange(n - seed + 1)
    chosen = _smallest((_lots(data, seed, key) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - seed + 1)[start].astype(np.int64) & 0xFFFFFFFF
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([new[1:], [len(chosen)]]) - 1
    pos, lo, hi = chosen[new], start[new], start[last]
    head = np.zeros(len(pos), np.int64)
    for j in range(7):
        head = head * 256 + data[pos + j]
    d = doc[pos]
    base = offsets[:-1][d]
    return {"doc": d, "pos": pos - base, "lo": lo - base, "hi": hi - base, "seed": substring_hash(prefix, pos, pos + seed, key).view(np.int64), "context": substring_hash(prefix, lo, hi + length, key).view(np.int64), "head": head}


def _anchor_rows(length: int, seed: int, key: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text"):
                a = anchors(data, offsets, key, length, seed)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row").take(pa.array(a["doc"])), pa.array(a["pos"]), pa.array((a["pos"] - a["lo"]).astype(np.int32)), pa.array((a["hi"] - a["lo"]).astype(np.int32)), pa.array(a["head"]), pa.array(a["seed"]), pa.array(a["context"])],
                    ["row", "pos", "left", "span", "head", "seed", "context"],
                )

    return f


_ENTRY = ["head", "seed", "context", "left", "span"]


_ORDER = ["head", "seed", "context"]
_ROWS = "row long, pos long, left int, span int, head long, seed long, context long"
_LEVEL = "head long, seed long, context long, left int, span int, n long, row long, pos long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of sorted neighbours with different contexts (edge = false), and the first and last entry of the partition (edge = true)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        seed, context = (batch.column(k).to_numpy() for k in ("seed", "context"))
        if last is None:
            yield pa.RecordBatch.from_arrays([pa.array(seed[:1]), pa.array(context[:1]), pa.array([True])], ["seed", "context", "edge"])
        else:
            seed, context = np.concatenate([last[0], seed]), np.concatenate([last[1], context])
        hit = np.unique(seed[1:][(seed[1:] == seed[:-1]) & (context[1:] != context[:-1])])
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(np.zeros(len(hit), np.int64)), pa.array(np.zeros(len(hit), bool))], ["seed", "context", "edge"])
        last = seed[-1:], context[-1:]
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1]), pa.array([True])], ["seed", "context", "edge"])


class SuffixIndex:
    """A folder with live levels, all anchors and the candidate seeds; an index on an old folder goes on where that one stopped."""

    def __init__(self, spark: SparkSession, path: str | None = None, length: int = LENGTH, seed: int = SEED):
        self.spark, self.path, self.length, self.seed = spark, path or new_path(spark, "suffixes"), length, seed
        self.levels: list[tuple[int, str]] = []
        self.version, self.key = 0, new_key()
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            state = spark.read.schema("version int, rank int, at string, key long").parquet(f"{self.path}/state")
            self.version = state.agg(F.max("version")).first()[0]
            live = state.where(F.col("version") == self.version).orderBy(F.desc("rank")).collect()  # a row for each level
            self.levels, self.key = [(r["rank"], r["at"]) for r in live], live[0]["key"]

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _sorted(self, rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange(n_parts(self.spark), *_ORDER).sortWithinPartitions(*_ORDER)

    def _level(self, rows: DataFrame, rank: int) -> str:
        merged = rows.groupBy(*_ENTRY).agg(F.sum("n").alias("n"), F.first("row").alias("row"), F.first("pos").alias("pos"))
        at = f"level-{self.version}-{rank}"
        self._sorted(merged).write.option("compression", "zstd").parquet(f"{self.path}/{at}")
        return at

    def add(self, rows: DataFrame) -> None:
        """Adds a batch of texts (row, text): its array, the scan with the live levels, then merges of equal levels."""
        self.version += 1
        rows.mapInArrow(_anchor_rows(self.length, self.seed, self.key), _ROWS).write.option("compression", "zstd").mode("append").parquet(f"{self.path}/anchors-{self.version}")
        new = self._level(self._table(f"anchors-{self.version}", _ROWS).withColumn("n", F.lit(1).cast("long")), 0)
        both = self._table(new, _LEVEL).select(*_ORDER)
        for _, at in self.levels:
            both = both.unionByName(self._table(at, _LEVEL).select(*_ORDER))
        found = saved(self._sorted(both).mapInArrow(_scan, "seed long, context long, edge boolean"), "scan")
        edges = found.where("edge").groupBy("seed").agg(F.min("context").alias("a"), F.max("context").alias("b")).where("a <> b").select("seed")
        found.where("NOT edge").select("seed").unionByName(edges).distinct().write.mode("append").parquet(f"{self.path}/shared")
        dropped(found)
        rank, old = 0, []
        while self.levels and self.levels[-1][0] == rank:
            old += [self.levels.pop()[1], new]
            rank += 1
            new = self._level(self._table(old[-2], _LEVEL).unionByName(self._table(old[-1], _LEVEL)), rank)
        self.levels.append((rank, new))
        self.spark.createDataFrame([(self.version, r, at, self.key) for r, at in self.levels], "version int, rank int, at string, key long").coalesce(1).write.mode("append").parquet(f"{self.path}/state")
        for at in old:
            gone = self._table(at, _LEVEL)
            gone.saved_at = f"{self.path}/{at}"
            dropped(gone)

    def entries(self) -> DataFrame:
        """All live entries; one that several levels have counts together."""
        both = self._table(self.levels[0][1], _LEVEL)
        if len(self.levels) == 1:
            return both
        for _, at in self.levels[1:]:
            both = both.unionByName(self._table(at, _LEVEL))
        return both.groupBy(*_ENTRY).agg(F.sum("n").alias("n"), F.first("row").alias("row"), F.first("pos").alias("pos"))

    def anchors(self) -> DataFrame:
        out = None
        for v in range(1, self.version + 1):
            own = self._table(f"anchors-{v}", _ROWS)
            out = own if out is None else out.unionByName(own)
        return out

    def cut(self, rows: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
        """The rows (doc_id, row, text) that were added, without what is repeated."""
        entries = self.entries()
        wanted = entries.join(self._table("shared", "seed long").distinct(), "seed", "left_semi")
        lists = wanted.groupBy("row").agg(F.collect_list(F.struct("seed", "context", "left", "span", "pos")).alias("wanted"))
        texts = rows.select("row", "text").join(lists, "row").dropDuplicates(["row"]).select("text", "wanted")
        contexts = saved(texts.mapInArrow(_contexts(self.length), "seed long, context long, left int, span int, bytes binary"), "contexts")
        entry = ["seed", "context", "left", "span"]
        runs = _repeated(contexts, self.length, widths, self.key)
        copies = entries.where("n > 1").select(*entry, F.lit(0).cast("long").alias("b"), (F.col("span") + 1).cast("long").alias("e"))
        flagged = saved(runs.unionByName(copies).groupBy(*entry).agg(F.collect_set(F.struct("b", "e")).alias("runs")), "flagged")
        dropped(contexts)
        own = self.anchors().join(flagged, entry).select("row", (F.col("pos") - F.col("left")).alias("lo"), F.explode("runs").alias("x"))
        own = own.groupBy("row").agg(F.collect_set(F.struct((F.col("lo") + F.col("x.b")).alias("b"), (F.col("lo") + F.col("x.e")).alias("e"))).alias("runs"))
        marked = rows.join(own, "row", "left").select("doc_id", "text", F.coalesce("runs", F.array().cast("array<struct<b:bigint,e:bigint>>")).alias("runs"))
        return marked.mapInArrow(_cut(self.length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")


def _contexts(length: int):
    """Bytes that the windows of each wanted entry cover."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text"):
                flat = rows.column("wanted").flatten()
                each = np.diff(rows.column("wanted").offsets.to_numpy())
                left, span = (flat.field(k).to_numpy().astype(np.int64) for k in ("left", "span"))
                begin = np.repeat(offsets[:-1], each) + flat.field("pos").to_numpy() - left
                size = span + length
                at = np.concatenate([[0], np.cumsum(size)])
                take = np.repeat(begin - at[:-1], size) + np.arange(at[-1])
                yield pa.RecordBatch.from_arrays([*(flat.field(k) for k in ("seed", "context", "left", "span")), binary(data[take], at)], ["seed", "context", "left", "span", "bytes"])

    return f


def _blocks(length: int, width: int, key: int):
    """Blocks of ``width`` distances of the windows in ``parts``: the windows, the hash of their core and of all their bytes."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in pieces(batch, "bytes"):
                prefix = prefix_hash(data, key)
                flat = rows.column("parts").flatten()
                row = np.repeat(np.arange(rows.num_rows), np.diff(rows.column("parts").offsets.to_numpy()))
                left, seed = (rows.column(k).to_numpy().astype(np.int64) for k in ("left", "seed"))
                near, far = left[row] - flat.field("e").to_numpy() + 1, left[row] - flat.field("b").to_numpy()
                each = far // width - near // width + 1
                step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                row, near, far = (np.repeat(x, each) for x in (row, near, far))
                low = (near // width + step) * width
                near, far = np.maximum(near, low), np.minimum(far, low + width - 1)
                anchor, own = at[:-1][row] + left[row], mix(seed[row].view(np.uint64), 5)
                core = mix(substring_hash(prefix, anchor - low, anchor + length - low - width + 1, key) + own + low.astype(np.uint64), 6)
                whole = mix(substring_hash(prefix, anchor - far, anchor + length - near, key) + own + near.astype(np.uint64), 7)
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k).take(pick) for k in ("seed", "context", "left", "span")), pa.array(left[row] - far), pa.array(left[row] - near + 1), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["seed", "context", "left", "span", "b", "e", "core", "whole"],
                )

    return f


def _repeated(contexts: DataFrame, length: int, widths: tuple[int, ...], key: int) -> DataFrame:
    """(seed, context, left, span, b, e): runs of windows that another entry has as well."""
    entry = ["seed", "context", "left", "span"]
    parts = contexts.withColumn("parts", F.array(F.struct(F.lit(0).cast("long").alias("b"), (F.col("span") + 1).cast("long").alias("e"))))
    runs = None
    for width in widths:
        blocks = saved(parts.mapInArrow(_blocks(length, width, key), "seed long, context long, left int, span int, b long, e long, core long, whole long"), "blocks")
        cores = blocks.groupBy("seed", "core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed", "core")
        alive = saved(blocks.join(cores, ["seed", "core"], "left_semi"), "alive")
        wholes = alive.groupBy("seed", "whole").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("context", "left", "span", "b", "e")))
        dropped(blocks)
        same = alive.join(wholes.where("n > 1").select("seed", "whole"), ["seed", "whole"], "left_semi").select(*entry, "b", "e")
        runs = same if runs is None else runs.unionByName(same)
        if width > 1:
            rest = wholes.groupBy(*entry).agg(F.collect_list(F.struct("b", "e")).alias("parts"))
            parts = saved(parts.drop("parts").join(rest, entry), "parts")
    return runs


def _cut(length: int):
    """Removes the windows listed in ``runs`` from each text."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text"):
                n = len(offsets) - 1
                runs = rows.column("runs")
                counts = np.diff(runs.offsets.to_numpy()) if len(runs) else np.zeros(0, int)
                flat = runs.flatten()
                begin = flat.field("b").to_numpy() + np.repeat(offsets[:-1], counts)
                end = flat.field("e").to_numpy() + np.repeat(offsets[:-1], counts) - 1 + length
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, begin, 1)
                np.add.at(edge, end, -1)
                gone = np.cumsum(edge[:-1]) > 0
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                inner = offsets[:-1][np.diff(offsets) > 0]
                first[inner] = gone[inner]
                total = np.concatenate([[0], np.cumsum(gone)])
                spans = np.concatenate([[0], np.cumsum(first)])
                texts, digest = [], []
                for i in range(n):
                    a, b = offsets[i], offsets[i + 1]
                    left = data[a:b][~gone[a:b]].tobytes() if total[b] > total[a] else data[a:b].tobytes()
                    texts.append(left)
                    digest.append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(total[offsets[1:]] - total[offsets[:-1]]), pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), pa.array(digest, pa.string()), pa.array(texts, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    return f


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, text) of a table of documents; ``row`` tells rows of different text apart."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, batches: int = BATCHES, widths: tuple[int, ...] = WIDTHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes (UTF-8, a cut may fall inside a character)."""
    rows = keyed(docs, id_col, text_col)
    index = SuffixIndex(docs.sparkSession, length=length, seed=seed)
    for b in range(batches):
        index.add(rows.where(F.pmod("row", F.lit(batches)) == b))
    return index.cut(rows, widths)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, whether a document lost anything, and what is left of it as text (U+FFFD where a cut fell inside a character)."""
    text = F.make_valid_utf8(F.col("kept_bytes").cast("string"))
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"), text.alias("text"))
