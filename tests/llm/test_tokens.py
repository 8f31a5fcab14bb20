"""Token ids against the tokenizers library, on texts with what a cut could break."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from exprflow.llm import tokens

ALPHABET = (
    list("aAbHhsStTwWdDlLmMvVrReEyY019'.,<|>-_&!") + [" ", "\t", "\n", "\x0b", "\x1c", " ", " ", "‍", "́", "̇", "̈", "̱", "̊", "̧"]
    + ["İ", "ı", "ß", "ẞ", "Σ", "ς", "é", "É", "é", "ǰ", "K", "Å", "ñ", "Ω", "中", "٣", "½", "😀", "👨‍👩", "ﬁ", "̈́", "﻿"]
    + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "endoftext|>", "'s", "'LL", "don't", "hello", "World", "</w>"]
)


def same(texts, path=None):
    lib = Tokenizer.from_file(path or tokens.tokenizer_path())
    offsets, ids = tokens.encoder(path).encode(pa.array(texts))
    want = [e.ids for e in lib.encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)]
    got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert [(t, g) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_random_texts_agree_with_the_library():
    rng = np.random.default_rng(11)
    same(["".join(rng.choice(ALPHABET, rng.integers(1, 14))) for _ in range(24_000)])


def test_special_tokens_letters_with_marks_and_odd_texts():
    same(["hello <|endoftext|> world", "x<|endoftext|>y", "İ<", "İ-", "İ.", "H̱ ẖ T̈", "", None, " \n", "a" * 5000, "A'S 'S don'T", "x." * 3000, "́start"])


def test_other_tokenizers_get_whole_texts(tmp_path):
    assert tokens.encoder().by_piece
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    assert not tokens.encoder(path).by_piece
    same(["hello  world\n x", "İ< a", "don't  <|endoftext|>", None], path)
    with open(tokens.tokenizer_path()) as f:
        base = json.load(f)
    for change in ({"added_tokens": [base["added_tokens"][0] | {"lstrip": True}]}, {"normalizer": None}, {"pre_tokenizer": base["pre_tokenizer"] | {"pretokenizers": []}}):
        assert not tokens.splits_at_space(base | change)


@pytest.mark.parametrize("limit", [1, 7])
def test_a_full_cache_starts_anew(monkeypatch, limit):
    monkeypatch.setattr(tokens, "CACHE_PIECES", limit)
    enc = tokens.PieceEncoder()
    texts = pa.array(["one Two, three; FOUR one two", "three one"])
    assert [x.tolist() for x in enc.encode(texts)] == [x.tolist() for x in tokens.encoder().encode(texts)]
