"""Units that the tokenizer of op5 gets as one string have the ids that they have alone, and texts end where they end."""

import random
import re

import pyarrow as pa
import pytest

from stratus.llm import sentence_pieces

TEXTS = ["", "▁", " ", "a ▁", "x  y   z ", "▁▁a ▁b", "end▁", "▁begin", "😀▁😀 é", "one two\ttwo\nthree", "今日 は", "  lead", "\x00 \x01"]


def test_units_joined_and_alone():
    pieces = sentence_pieces.Pieces(open(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"), "rb").read())
    r = random.Random(2)
    units = TEXTS[1:] + ["▁" + "".join(r.choice("etaoinshrdé今😀.,") for _ in range(r.randint(0, 12))) for _ in range(500)]
    want = [pieces.tokenizer.encode(u, add_special_tokens=False).ids for u in units]
    given, real = [], pieces.tokenizer
    pieces.tokenizer = type("Counted", (), {"encode_batch_fast": lambda _, texts, **how: given.extend(texts) or real.encode_batch_fast(texts, **how)})()
    assert pieces.encode_units(units) == want and len(given) < len(units) // 5


def test_units_begin_where_the_pattern_says():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    pieces, library = sentence_pieces.Pieces(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    marked = [pieces.normalised(t).encode() for t in TEXTS] + ["no mark▁first".encode(), b"x", b""]
    ends = [0]
    for m in marked:
        ends.append(ends[-1] + len(m))
    want = []
    for begin, m in zip(ends, marked, strict=False):
        text = m.decode()
        want += [begin + len(text[: x.start()].encode()) for x in re.finditer("▁*[^▁]+|▁+", text)]
    assert pieces.bounds(sentence_pieces.np.frombuffer(b"".join(marked), "u1"), sentence_pieces.np.array(ends)).tolist() == want
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS)], ["doc_id", "text"])
    got = [r for b in sentence_pieces._encode(path)(iter([rows])) for r in b.to_pylist()]
    assert [sentence_pieces.np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [library.encode(t) for t in TEXTS] and all(r["parity"] for r in got)
