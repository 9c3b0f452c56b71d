"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here; the tokenizer gets its normaliser, metaspace marker, pieces with scores (unigram
models as they are, byte-pair models as merges in score order) and byte fallback. No piece goes on past white space, so a
text is encoded in units (white space and the word after it), each once per worker while MEMO units are enough; units of a pass are told apart by Arrow, batches of
new ones, JOINED to a string, are encoded by THREADS threads of the library. Every whole text is also encoded by the sentencepiece library and compared id by id (``parity``), and
every new unit is decoded again (``round_trip``).

Null and empty texts have no pieces. Repeated rows have equal results; extra columns play no part; an empty table gives an
empty result. A literal metaspace marker decodes to a space.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import chunks, documents, utf8

#: Marker of white space, units that a worker remembers, threads of the library in a task.
MARK, MEMO, THREADS = "▁", 400_000, 2
#: Units that the tokenizer gets as one string, bytes of texts whose units are told apart together.
JOINED, PASS = 64, 4_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[i : i + size]
            i += size


def parse_model(raw: bytes) -> dict:
    """Pieces (text, score, type) and the settings of a model file."""
    pieces, trainer, normal = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, 1)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    return {"pieces": pieces, "bpe": trainer.get(3, 1) == 2, "byte_fallback": bool(trainer.get(35, 0)), "charsmap": normal.get(2, b""), "dummy_prefix": bool(normal.get(3, 1)), "collapse": bool(normal.get(4, 1))}


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, raw: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import Tokenizer, decoders, models, normalizers

        m = self.model = parse_model(raw)
        texts = [p for p, _, _ in m["pieces"]]
        vocab = {p: i for i, p in enumerate(texts)}
        unk = next((i for i, (_, _, kind) in enumerate(m["pieces"]) if kind == 2), 0)
        if m["bpe"]:
            plain = {p for p, _, kind in m["pieces"] if kind in (1, 4)}
            merges = [(-score, vocab[p], p[:k], p[k:]) for p, score, kind in m["pieces"] if kind in (1, 4) for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
            model = models.BPE(vocab, [(a, b) for _, _, a, b in sorted(merges)], unk_token=texts[unk], fuse_unk=True, byte_fallback=m["byte_fallback"])
        else:
            model = models.Unigram([(p, s) for p, s, _ in m["pieces"]], unk, m["byte_fallback"])
        self.tokenizer = Tokenizer(model)
        self.normal = normalizers.Precompiled(m["charsmap"]) if m["charsmap"] else None
        self.tokenizer.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
        self.bytes = np.array([kind == 6 for _, _, kind in m["pieces"]])
        self.split = not any(re.search(f"[^{MARK}]{MARK}", p) for p in texts)
        self.opens = np.array([p.startswith(MARK) for p in texts])
        self.joins = self.split and m["bpe"] and MARK in vocab

    def normalised(self, text: str) -> str:
        """The text that is cut into pieces, with its marks."""
        if self.normal:
            text = self.normal.normalize_str(text)
        if self.model["collapse"]:
            text = re.sub(" {2,}", " ", text).strip(" ")
        return (MARK * self.model["dummy_prefix"] + text.replace(" ", MARK)) if text else ""

    def units(self, text: str) -> list[str]:
        marked = self.normalised(text)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) if self.split else [marked] if marked else []

    def bounds(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the units of marked texts begin: at a mark behind anything else, and at each text's begin (``at``: offsets in UTF-8)."""
        new = np.zeros(len(data), bool)
        if self.split and len(data) > 2:
            a, b, c = MARK.encode()
            mark = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
            new[:-2] = mark
            new[3:-2] &= ~mark[:-3]
        new[at[:-1][np.diff(at) > 0]] = True
        return np.flatnonzero(new)

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit. No merge of letters goes on past a mark, so words with one mark before them are encoded JOINED at a time and cut at the pieces with a mark."""
        one = [k for k, u in enumerate(units) if len(u) > 1 and u.startswith(MARK) and u.count(MARK) == 1] if self.joins else []
        groups = [one[k : k + JOINED] for k in range(0, len(one), JOINED)]
        out: list[list[int] | None] = [None] * len(units)
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(map(units.__getitem__, g)) for g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            cuts = np.flatnonzero(self.opens[ids]).tolist()
            if len(cuts) == len(group):
                for k, i, j in zip(group, cuts, [*cuts[1:], len(ids)], strict=True):
                    out[k] = ids[i:j]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([units[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = [self.units(t) for t in texts]
        new = list(set().union(*found)) if found else []
        memo = dict(zip(new, self.encode_units(new), strict=True))
        return [[i for u in us for i in memo[u]] for us in found]

    def decode_marked(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_marked(ids).replace(MARK, " ")
        return text[1:] if self.model["dummy_prefix"] and text.startswith(" ") else text


@functools.lru_cache(1)
def _tools(path: str, changed: int) -> tuple:
    """Encoder, sentencepiece's own one, ids of units and units that do not come back: made once a worker, for all of its tasks on a file."""
    import sentencepiece

    with open(path, "rb") as file:
        pieces = Pieces(file.read())
    return pieces, sentencepiece.SentencePieceProcessor(model_file=path), {}, set()


def _encode(path: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, library, ids, lost = _tools(path, os.stat(path).st_mtime_ns)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            raw = data.tobytes()
            for i, j in chunks(at, PASS):
                texts = [raw[at[k] : at[k + 1]].decode() for k in range(i, j)]
                marked = [pieces.normalised(t).encode() for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(m) for m in marked])]).astype(np.int64)
                letters = np.frombuffer(b"".join(marked), np.uint8)
                starts = pieces.bounds(letters, ends)
                coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(letters))), pa.py_buffer(letters)]).dictionary_encode()
                which, units = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                first = np.searchsorted(starts, ends)
                found = list(map(ids.get, units))
                new = [k for k, x in enumerate(found) if x is None]
                if len(ids) + len(new) > MEMO:
                    ids.clear()
                    lost.clear()
                    new = range(len(units))
                named = [units[k].decode() for k in new]
                got = pieces.encode_units(named)
                back = pieces.tokenizer.decode_batch(got, skip_special_tokens=False)
                for k, u, g, t in zip(new, named, got, back, strict=True):
                    ids[units[k]] = found[k] = array("I", g).tobytes()
                    if t != u:
                        lost.add(units[k])
                theirs = library.encode(texts, num_threads=1)  # a second thread costs time here
                whole = b"".join(map(found.__getitem__, which.tolist()))
                upto = np.concatenate([[0], np.cumsum(np.array([len(x) for x in found], np.int64)[which])])[first]
                out = [whole[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                flat = np.frombuffer(whole, "<u4")
                bad = np.concatenate([[0], np.cumsum(np.array([u in lost for u in units], bool)[which])])[first] if lost else np.zeros(len(first), int)
                size = np.array([len(x) // 4 for x in out], np.int64)
                total = np.concatenate([[0], np.cumsum(pieces.bytes[flat])])
                ends = np.cumsum(size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(size), pa.array((total[ends] - total[ends - size]).astype(np.int64)), pa.array([zlib.crc32(x) for x in out], pa.int64()), pa.array([array("I", t).tobytes() == x for t, x in zip(theirs, out, strict=True)]), pa.array(np.diff(bad) == 0), pa.array(out, pa.binary())],
                    ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "parity", "round_trip", "ids"],
                )

    return f


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, parity (with sentencepiece), round_trip and ids (little-endian uint32)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(model), "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, parity boolean, round_trip boolean, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from the ids of :func:`encode`."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(model, "rb") as file:
            pieces = Pieces(file.read())
        for batch in batches:
            texts = [pieces.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(f, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")
