"""Document quality from line labels: a linear-chain conditional random field marks each line as content or boilerplate.

Lines with a word get binary features (length, symbols, digits, repetition, sentence end, ...). Weights and transitions
are fitted by maximum likelihood on a bounded sample of labelled documents (FIT_DOCS, smallest hashes of the id), whose
lines all carry the document's label. Viterbi decoding labels the lines of each text; the share of words in content lines
decides retention. Without usable labels the stated prior weights decide.

Null, empty and blank texts have no word and fail the base rules. Repeated rows get the same verdict. Extra columns play no
part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import OWN_KEY, documents, mix, pieces, prefix_hash, substring_hash, words

#: Labelled documents that the model is fitted on at most, lines of a fitted sequence, share of words that must be content.
FIT_DOCS, FIT_LINES, CONTENT = 4000, 64, 0.5
#: Bound of the fitted transition scores: a document-wide label would let a single odd line decide on the whole text.
MOST_STAY = 1.0
FEATURES = ("bias", "1-2 words", "3-5 words", "over 60 words", "a symbol", "symbols over 2 %", "symbols over 10 %", "ends a sentence", "seen before", "repeated words over 30 %", "repeated words over 60 %", "digits over 10 %", "mean word over 12", "mean word under 3", "over 30 % capitals", "a bar")
#: Prior weights of the features for content over boilerplate.
PRIOR = np.array([1.0, -0.3, 0.0, 0.2, -0.3, -1.0, -2.0, 1.0, -0.8, -1.5, -2.0, -0.5, -0.5, -0.5, -0.5, -1.0])
PRIOR_STAY = 1.0


def line_features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document, and of each line with a word its document, words and features as bits."""
    n, size = len(offsets) - 1, len(data)
    start, end, doc = words(data, offsets)
    n_words = np.bincount(doc, minlength=n)
    cont = (data & 0xC0) == 0x80
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    sums = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in (("chars", ~cont & ~blank), ("symbols", symbol), ("digits", (data >= 48) & (data <= 57)), ("capitals", (data >= 65) & (data <= 90)), ("bars", data == 124))}
    prefix = prefix_hash(data, OWN_KEY)
    # words in three-word windows that the text has twice
    w = substring_hash(prefix, start, end, OWN_KEY)
    again = np.zeros(len(w), bool)
    if len(w) > 2:
        ok = np.flatnonzero(doc[2:] == doc[:-2])
        tri = mix(mix(mix(w[ok], 1) + w[ok + 1], 2) + w[ok + 2], 3) + mix(doc[ok].astype(np.uint64), 4)
        order = np.argsort(tri, kind="stable")
        same = tri[order][1:] == tri[order][:-1]
        hit = np.zeros(len(ok), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        for k in range(3):
            again[ok[hit] + k] = True
    # lines
    edge = np.concatenate([np.flatnonzero(data == 10) + 1, offsets[:-1]]) if size else np.zeros(0, np.int64)
    begin = np.unique(edge[edge < size])
    line_doc = np.searchsorted(offsets, begin, "right") - 1
    stop = np.concatenate([begin[1:], [size]]) if len(begin) else begin
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10)) if size else stop
    stop = np.minimum(stop, offsets[line_doc + 1]) if len(begin) else stop
    at = np.searchsorted(start, np.concatenate([begin, [size]])) if len(begin) else np.zeros(1, np.int64)
    count = np.diff(at)
    full = np.flatnonzero(count > 0)
    begin, stop, line_doc, lo, hi, count = begin[full], stop[full], line_doc[full], at[:-1][full], at[1:][full], count[full]
    key = mix(substring_hash(prefix, begin, stop, OWN_KEY) + mix(line_doc.astype(np.uint64), 9), 8)
    order = np.argsort(key, kind="stable")
    seen = np.zeros(len(key), bool)
    seen[order[1:][key[order][1:] == key[order][:-1]]] = True
    got = {k: s[stop] - s[begin] for k, s in sums.items()}
    chars = np.maximum(got["chars"], 1)
    cum = np.concatenate([[0], np.cumsum(again)])
    repeated = (cum[hi] - cum[lo]) / np.maximum(count, 1)
    final = data[end[hi - 1] - 1] if len(hi) else np.zeros(0, np.uint8)
    bits = [
        np.ones(len(count), bool), count <= 2, (count >= 3) & (count <= 5), count > 60, got["symbols"] > 0, got["symbols"] > 0.02 * chars, got["symbols"] > 0.1 * chars,
        np.isin(final, np.frombuffer(b".!?", np.uint8)), seen, repeated > 0.3, repeated > 0.6, got["digits"] > 0.1 * chars, chars > 12 * count, chars < 3 * count, got["capitals"] > 0.3 * chars, got["bars"] > 0,
    ]
    per = lambda s: s[offsets[1:]] - s[offsets[:-1]]
    return {
        "n_words": n_words, "word_chars": per(sums["chars"]), "n_symbols": per(sums["symbols"]), "n_dup_lines": np.bincount(line_doc[seen], minlength=n), "n_repeat_words": np.bincount(doc[again], minlength=n),
        "line_doc": line_doc, "line_words": count, "bits": sum(b.astype(np.int64) << k for k, b in enumerate(bits)) if len(count) else np.zeros(0, np.int64),
    }


def _matrix(bits: np.ndarray) -> np.ndarray:
    return ((bits[..., None] >> np.arange(len(FEATURES))) & 1).astype(np.float64)


class Crf:
    """Two labels, 1 for content; ``weights`` score label 1, ``trans[a, b]`` a step from a to b."""

    def __init__(self, weights: np.ndarray = PRIOR, trans: np.ndarray | None = None):
        self.weights, self.trans = np.asarray(weights, float), np.array([[PRIOR_STAY, 0.0], [0.0, PRIOR_STAY]]) if trans is None else trans

    @classmethod
    def fit(cls, sequences: list[np.ndarray], labels: np.ndarray, steps: int = 150, penalty: float = 2.0) -> Crf:
        """Penalised maximum likelihood; each sequence's lines all have its label, and the rarer label weighs more."""
        if len(set(labels.tolist())) < 2:
            return cls()
        cut = [(s[k : k + FIT_LINES], y) for s, y in zip(sequences, labels.tolist(), strict=True) for k in range(0, len(s), FIT_LINES)]
        size = np.array([len(s) for s, _ in cut])
        bits = np.zeros((len(cut), size.max()), np.int64)
        for i, (s, _) in enumerate(cut):
            bits[i, : len(s)] = s
        y = np.array([v for _, v in cut])
        x, there = _matrix(bits), np.arange(size.max()) < size[:, None]
        share = np.bincount(y, weights=size, minlength=2)
        weight = np.sqrt(share.sum() / (2 * share))[y]
        w, t = np.zeros(len(FEATURES)), np.zeros((2, 2))
        m = [np.zeros(len(FEATURES)), np.zeros((2, 2))]
        v = [np.zeros(len(FEATURES)), np.zeros((2, 2))]
        true_t = np.zeros((2, 2))
        np.add.at(true_t, (y, y), weight * (size - 1))
        true_w = np.einsum("n,nlf->f", weight * y, x * there[..., None])
        for step in range(1, steps + 1):
            emit = np.stack([np.zeros(x.shape[:2]), x @ w], axis=2)
            node, pair = cls._expect(emit, t, there)
            grad_w = true_w - np.einsum("n,nl,nlf->f", weight, node[..., 1] * there, x) - penalty * w
            grad_t = true_t - np.einsum("n,nab->ab", weight, pair) - penalty * t
            for k, (p, g) in enumerate(((w, grad_w), (t, grad_t))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            np.clip(t, -MOST_STAY, MOST_STAY, out=t)
        return cls(w, t)

    @staticmethod
    def _expect(emit: np.ndarray, t: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels and of steps, by forward and backward passes."""
        n, length, _ = emit.shape
        a, b = np.zeros_like(emit), np.zeros_like(emit)
        a[:, 0] = emit[:, 0]
        for k in range(1, length):
            new = emit[:, k] + np.logaddexp(a[:, k - 1, 0, None] + t[0], a[:, k - 1, 1, None] + t[1])
            a[:, k] = np.where(there[:, k, None], new, a[:, k - 1])
        for k in range(length - 2, -1, -1):
            ahead = emit[:, k + 1] + b[:, k + 1]
            new = np.logaddexp(ahead[:, 0, None] + t[:, 0], ahead[:, 1, None] + t[:, 1])
            b[:, k] = np.where(there[:, k + 1, None], new, 0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        node = np.exp(a + b - z[:, None, None])
        step = np.exp(a[:, :-1, :, None] + t + (emit + b)[:, 1:, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
        return node, step.sum(axis=1)

    def decode(self, bits: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi labels of lines; ``first`` marks the first line of each document."""
        emit = _matrix(bits) @ self.weights
        (t00, t01), (t10, t11) = self.trans.tolist()
        back = []
        s0 = s1 = 0.0
        for e, f in zip(emit.tolist(), first.tolist(), strict=True):
            if f:
                back.append((-1, -1))
                s0, s1 = 0.0, e
            else:
                a0, a1 = s0 + t00 >= s1 + t10, s0 + t01 > s1 + t11
                back.append((0 if a0 else 1, 0 if a1 else 1))
                s0, s1 = (s0 + t00 if a0 else s1 + t10), (s0 + t01 if a1 else s1 + t11) + e
                base = max(s0, s1)
                s0, s1 = s0 - base, s1 - base
            back[-1] += (s1 >= s0,)
        label, out = 0, np.zeros(len(back), np.int8)
        open_ = True
        for k in range(len(back) - 1, -1, -1):
            if open_:
                label = int(back[k][2])
            out[k] = label
            open_ = back[k][0] < 0
            if not open_:
                label = back[k][label]
        return out


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in pieces(batch, "text"):
            f = line_features(data, offsets)
            cut = np.searchsorted(f["line_doc"], np.arange(1, len(offsets) - 1))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), pa.array([x.tolist() for x in np.split(f["bits"], cut)], pa.list_(pa.int64()))], ["doc_id", "quality", "bits"])


def fit(docs: DataFrame, labels: DataFrame | None, most: int = FIT_DOCS) -> Crf:
    """A model from at most ``most`` labelled documents; the prior one without labels."""
    if labels is None:
        return Crf()
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    sample = sample.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # at most ``most`` rows
    got = sorted((r for r in rows.mapInArrow(_fit_rows, "doc_id long, quality int, bits array<long>").collect() if r.bits), key=lambda r: (r.doc_id, r.bits))
    return Crf.fit([np.array(r.bits) for r in got], np.array([r.quality for r in got])) if got else Crf()


def _judge(model: Crf, content: float):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text"):
                x = line_features(data, offsets)
                n = len(offsets) - 1
                first = np.ones(len(x["line_doc"]), bool)
                first[1:] = x["line_doc"][1:] != x["line_doc"][:-1]
                good = np.bincount(x["line_doc"], weights=x["line_words"] * model.decode(x["bits"], first), minlength=n)
                failed = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
                share = good / np.maximum(x["n_words"], 1)
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
                yield pa.RecordBatch.from_arrays([*(c for c, k in zip(rows.columns, rows.schema.names, strict=True) if k != "text"), *(pa.array(x[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(share), pa.array(~failed & (share >= content))], [*(k for k in rows.schema.names if k != "text"), *names, "base_failed", "content_share", "kept"])

    return f


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge(docs: DataFrame, model: Crf, content: float = CONTENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts, base_failed, content_share and kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_judge(model, content), f"doc_id long, {COUNTS}")


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, fit(docs, labels_of(spark, sf_dir)))


def kept_documents(docs: DataFrame, model: Crf, content: float = CONTENT) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns; the text travels once, nothing is shuffled."""
    judged = _judge(model, content)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [r.column("kept") for r in judged(iter([batch.select(["doc_id", "text"])]))]
            if verdicts:
                yield batch.filter(pa.concat_arrays(verdicts))

    return docs.mapInArrow(f, docs.schema)
