"""What a worker of op5 keeps between its tasks."""

import pyarrow as pa
import pytest

from stratus.llm import sentence_pieces

TEXTS = ["one two two three", None, "", "three  four\tfive é 今日 😀", "one ▁ two", "two two " * 50]


def _batches(texts):
    return iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])])


def test_encoder_is_made_once(monkeypatch):
    pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    made, real = [], sentence_pieces.Pieces
    monkeypatch.setattr(sentence_pieces, "Pieces", lambda raw: made.append(1) or real(raw))
    get = lambda texts: [r for b in sentence_pieces._encode(path)(_batches(texts)) for r in b.to_pylist()]
    first = get(TEXTS)
    assert all(r["parity"] for r in first) and get(TEXTS) == first and len(made) <= 1
    monkeypatch.setattr(sentence_pieces, "MEMO", 3)  # forgets between texts
    assert [get([t])[0] | {"doc_id": k} for k, t in enumerate(TEXTS)] == first
    sentence_pieces._tools.cache_clear()
