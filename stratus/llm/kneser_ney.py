"""Perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters in a lossless code of 12-bit symbols: a code point below DIRECT is one symbol, any other one is two,
of its upper and its lower bits, which have symbols of their own. ORDER symbols are a gram, packed in one long; a text begins with
start symbols. Perplexity is by code point. All trusted documents are counted: grams are added up in the tasks, then by gram.
Lower orders are continuation counts. Probabilities come from joins of the grams that the documents hold with the count and
context tables of each order, all sharded by key. The scored grams reach the documents as a lookup table if there are at
most TABLE of them (a checked bound), else block by block in a cogroup.

One of FOLDS parts of the trusted documents (by hash of the id) is left out of the model; thresholds are quantiles of its
perplexity in each language, for the model knows its own texts too well. A language without such documents takes the quantile of
all of them, and if there are none the trusted ones do. Null and empty texts have no perplexity and aren't kept. Without trusted text all others are kept.
Rows repeated under one id or without one count each, by their own text; extra columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import documents, pieces, plain_text, saved

#: Characters of a gram, bits of one, quantile of a language, grams of a lookup table and labels of a broadcast at most.
ORDER, BITS, QUANTILE, TABLE, LABELS = 5, 12, 0.995, 4_000_000, 1_000_000
#: Characters of the texts that meet in one block of the cogroup, times 64.
BLOCK_CHARS = 1_000_000_000
#: Code points that are one symbol; of others the upper bits (at most 544 values) and the lower 11 bits follow after DIRECT.
DIRECT, _UPPER, _LOWER = 1500, 1500, 2045
_START = 4094
#: Parts of the trusted documents, one of which gives the thresholds.
FOLDS = 5


def symbols(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of code points one after the other, n + 1 bounds of the code points' symbols)."""
    wide = points >= DIRECT
    at = np.concatenate([[0], np.cumsum(1 + wide)])
    out = np.empty(at[-1], np.int64)
    out[at[:-1]] = np.where(wide, _UPPER + (points >> 11), points)
    out[at[1:][wide] - 1] = _LOWER + (points[wide] & 2047)
    return out, at


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed grams of all texts one after the other, n + 1 bounds, code points of each text); one for each symbol."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    units, bounds = symbols(points)
    at = bounds[lead]
    out = units.copy()
    place = np.arange(len(units)) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, ORDER):
        before = np.full(len(units), _START, np.int64)
        before[k:] = units[:-k] if len(units) > k else before[k:]
        before[place < k] = _START
        out |= before << (BITS * k)
    return out, at, np.diff(lead)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in pieces(batch, "text"):
            g, at, _ = grams(data, offsets)
            trusted = np.repeat(rows.column("trusted").to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
            key, inverse = np.unique(g, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(inverse, weights=trusted, minlength=len(key)).astype(np.int64))], ["g", "c"])


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts; fixed ones where a count is missing."""
    if not (ones and twos and threes):
        return 0.5, 1.0, 1.5
    y = ones / (ones + 2 * twos)
    d = (1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes)
    return tuple(min(max(x, 0.05), k) for x, k in zip(d, (1, 2, 3), strict=True))


def log_probabilities(counted: DataFrame) -> DataFrame:
    """(g, logp) for every gram in ``counted`` (g, c); c is its count in trusted text, 0 if it is only looked up."""
    wanted = counted.select("g")
    table = counted.where("c > 0").select("g", "c")
    terms = []
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            table = saved(table.select((F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c")), f"order{k}")
        n = table.agg(*(F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)), F.count(F.lit(1))).first()
        d1, d2, d3 = discounts(*n[:4])
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = table.groupBy(F.shiftrightunsigned("g", BITS).alias("x")).agg(F.sum("c").alias("sum"), F.sum(cut).alias("cut")).select("x", "sum", (F.col("cut") / F.col("sum")).alias(f"gamma{k}"))
        own = table.withColumn("x", F.shiftrightunsigned("g", BITS)).join(context.select("x", "sum"), "x").select(F.col("g").alias(f"g{k}"), ((F.col("c") - cut) / F.col("sum")).alias(f"alpha{k}"))
        terms.append((k, own, context.select(F.col("x").alias(f"x{k}"), f"gamma{k}"), n[4]))
    out = wanted
    p = None
    for k, own, context, types in reversed(terms):
        key = F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))
        out = out.withColumn(f"g{k}", key).withColumn(f"x{k}", F.shiftrightunsigned(key, BITS)).join(own, f"g{k}", "left").join(context, f"x{k}", "left")
        below = F.lit(1.0 / (types + 1)) if p is None else F.col("p")
        p = F.coalesce(f"alpha{k}", F.lit(0.0)) + F.coalesce(f"gamma{k}", F.lit(1.0)) * below
        out = out.select("g", p.alias("p"))
    return out.select("g", F.log("p").alias("logp"))


def _score_rows(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, key: np.ndarray, logp: np.ndarray) -> pa.RecordBatch:
    g, at, n = grams(data, offsets)
    total = np.concatenate([[0.0], np.cumsum(logp[np.searchsorted(key, g)])]) if len(g) else np.zeros(1)
    ppl = np.exp(-(total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1))
    return pa.RecordBatch.from_arrays([*(rows.column(k) for k in ("doc_id", "lang", "judged")), pa.array(n), pa.array(np.round(ppl, 6), mask=n == 0)], ["doc_id", "lang", "judged", "n_chars", "perplexity"])


_SCORED = "doc_id long, lang string, judged boolean, n_chars long, perplexity double"


def score(rows: DataFrame, model: DataFrame, most: int = TABLE) -> DataFrame:
    """Perplexity of ``rows`` (doc_id, lang, judged, text) from ``model`` (g, logp), which has all their grams."""
    size = model.count()
    if size <= most:
        got = model.orderBy("g").toArrow()  # at most TABLE rows
        table = rows.sparkSession.sparkContext.broadcast((got.column("g").to_numpy(), got.column("logp").to_numpy().astype(np.float64)))

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, logp = table.value
            for batch in batches:
                for part, data, offsets in pieces(batch, "text"):
                    yield _score_rows(part, data, offsets, key, logp)

        return rows.mapInArrow(f, _SCORED)
    # a block has a bounded share of the grams and of the text
    length = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(max(1, size // most, length // BLOCK_CHARS)) * 64
    own = rows.where("length(text) > 0").withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                g, at, _ = grams(data, offsets)
                block = np.repeat(part.column("block").to_numpy(), np.diff(at))
                for b in np.unique(block):
                    key = np.unique(g[block == b])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), b, np.int32)), pa.array(key)], ["block", "g"])

    answers = own.mapInArrow(requests, "block int, g long").distinct().join(model, "g")

    def cogroup(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("g")
        key, logp = right.column("g").to_numpy(), right.column("logp").to_numpy()
        return pa.Table.from_batches([_score_rows(part, data, offsets, key, logp) for batch in left.combine_chunks().to_batches() for part, data, offsets in pieces(batch, "text")])

    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cogroup, _SCORED).unionByName(rows.where("length(text) = 0").select("doc_id", "lang", "judged", F.lit(0).cast("long").alias("n_chars"), F.lit(None).cast("double").alias("perplexity")))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, table: int = TABLE) -> DataFrame:
    """One row per document: doc_id, lang, n_chars, perplexity, threshold, kept."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = trusted.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0)
    if trusted.where("held").isEmpty() or trusted.where("NOT held").isEmpty():
        trusted = trusted.withColumn("held", F.lit(None).cast("boolean"))
    # part 0 is no part of the model; without parts the documents of the model give the thresholds
    trusted = trusted.select("doc_id", F.coalesce(~F.col("held"), F.lit(True)).alias("trusted"), F.coalesce("held", F.lit(True)).alias("judged"))
    small = trusted.limit(LABELS + 1).count() <= LABELS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), plain_text().alias("text"))
    rows = rows.join(F.broadcast(trusted) if small else trusted.hint("merge"), "doc_id", "left").select("doc_id", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"), F.coalesce("judged", F.lit(False)).alias("judged"), "text")
    counted = saved(rows.mapInArrow(_count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")), "grams")
    model = saved(log_probabilities(counted), "model")
    scored = saved(score(rows, model, table), "scored")
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    each = scored.where("judged").groupBy(F.col("lang").alias("trusted_lang")).agg(limit.alias("own"))
    whole = scored.where("judged").agg(limit).first()[0]
    out = scored.join(each, F.col("lang").eqNullSafe(F.col("trusted_lang")), "left").select("doc_id", "lang", "n_chars", "perplexity", F.coalesce("own", F.lit(whole).cast("double")).alias("threshold"))
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.coalesce("threshold", "perplexity"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
