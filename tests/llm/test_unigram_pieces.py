"""A unigram model, written by hand as protobuf, with white space collapse and byte fallback, against the sentencepiece library."""

import random
import struct

import numpy as np
import sentencepiece

from stratus.llm import sentence_pieces


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value if isinstance(value, bytes) else value.encode()
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _model():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    words = ["\u2581", "\u2581the", "\u2581th", "the", "he", "at", "\u2581a", "ing", "in", "ng", "\u2581re", "er", *"abcdefghijklmnopqrstuvwxyz"]
    pieces += [(w, -1.5 - 0.37 * k, 1) for k, w in enumerate(words)]
    body = b"".join(_field(1, _field(1, p) + _field(2, s) + _field(3, kind)) for p, s, kind in pieces)
    return body + _field(2, _field(3, 1) + _field(35, 1) + _field(40, 0) + _field(41, 1) + _field(42, 2)) + _field(3, _field(1, "identity") + _field(3, 1) + _field(4, 1) + _field(5, 1))


def test_unigram_scores_and_fallback(spark, tmp_path):
    path = tmp_path / "u.model"
    path.write_bytes(_model())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    parsed = sentence_pieces.parse_model(path.read_bytes())
    assert not parsed["bpe"] and parsed["byte_fallback"] and parsed["collapse"] and parsed["dummy_prefix"]
    r = random.Random(4)
    texts = ["".join(r.choice(["the", "at", "ing", "re", " ", "  ", "x", "z\u00e9", "\u4eca"]) for _ in range(r.randint(1, 60))) for _ in range(60)] + ["", None, " ", " a  b "]
    docs = spark.createDataFrame([(k % 50, t, 1) for k, t in enumerate(texts)] + [(None, "the thing", 1)], "doc_id long, text string, ids int")
    got = sentence_pieces.encode(docs, str(path)).collect()
    assert sorted(np.frombuffer(x.ids, "<u4").tolist() for x in got) == sorted(library.encode(t or "") for t in [*texts, "the thing"])
    assert all(x.parity for x in got) and len({x.n_pieces for x in got}) > 5
