"""The tokenizer's tables and merges against the public library."""

import random
from pathlib import Path

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from pagewake.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer(Path(FILE).read_text())


def texts():
    rng = random.Random(5)
    parts = ["the", "ciónes", "ßen", "aa", "aaa", "ing", "Ж", "ñ", "9", "²", "Ⅷ", "'s", ".", ",", "?", "…", "\n", "\t", "\x1f", "\0", "漢", "é", "x" * 70, " ", "  "]
    return ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(400)] + ["", " ", ".", " .", "a" * 5000, "ab " * 300]


def test_encoding_is_the_library_s_with_a_small_table(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "TOKENS", 20)
    ref = Tokenizer.from_file(FILE)
    for text in texts():
        ids = tokenizer.encode(text).tolist()
        assert ids == ref.encode(text, add_special_tokens=False).ids and tokenizer.decode(ids) == text
    assert len(tokenizer.tokens) <= 20


def test_letters_that_are_taken_without_the_pattern_are_its_letters():
    plain = [c for c in map(chr, range(0xD800)) if bpe.PLAIN.fullmatch(" " + c)]
    assert len(plain) > 500 and all(regex.fullmatch(r"\p{L}", c) for c in plain)


def test_new_words_are_merged_once_and_without_the_pattern(tokenizer, monkeypatch):
    merged, matched = [], []
    monkeypatch.setattr(tokenizer, "merge", lambda data, real=tokenizer.merge: merged.append(data) or real(data))
    monkeypatch.setattr(tokenizer, "piece", lambda text, real=tokenizer.piece: matched.append(text) or real(text))
    words = ["".join(random.Random(i).choices("abcdéfgh", k=12)) for i in range(50)]
    tokenizer.encode(" ".join(["x", *[w + rng for w in words for rng in ("", ",", "")]]))
    assert matched == ["x"] and [merged.count(f" {w}".encode()) for w in words] == [1] * 50
