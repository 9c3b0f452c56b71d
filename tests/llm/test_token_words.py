"""Ids made from words are those of the whole text, whatever stands between and around the words."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stratus.llm import token_blocks

ALPHABET = "abcXYZ019.,'’̧́̈éÉÅẛßİıΣσς今日는각가😀‍ \u0085　﻿ \n\t\x1c\x1f<|>#$ﬁ"
TEXTS = ["", " ", "x.<|ENDOFTEXT|>a. B.", "<|startoftext|>A. b.", "<|endoftext|>", "Foo.,", "Foo,. bar. x.", "!. ?, a.b. c,d,", "é. É.", "ΑΣ ΑΣ.", "Long" * 5000 + "."]


def test_words_and_whole_texts_agree():
    r, path = random.Random(1), public_tokenizers.path("word_bpe_49k.json")
    texts = TEXTS + ["".join(r.choice(ALPHABET) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    whole = Tokenizer.from_file(path)
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert token_blocks.by_words(path)
    assert token_blocks.encoder(path)([t.encode() for t in texts]) == want
