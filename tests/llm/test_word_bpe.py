"""Word-end BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import unicodedata

import pytest

from shiftgrid.llm import queries, word_bpe

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

ODD = ["'s", "'", "'LL", "Σ", "σ", "İ", "ß", "é", "é", "日", "한", "ǅ", "½", "①", "٣", " ", "\x85", "\x1c", "\x0b", " ", "\n",
       "a", "B", "the", "ing", "12", "#$", "<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "͸", "😀", "‍", "\U00010d50",
       "\U000323b0", "\x00", "ﬁ", "Å", "�", "​", "﻿"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.word_model())


@pytest.fixture(scope="module")
def encoder():
    with open(queries.word_model(), "rb") as f:
        return word_bpe.Encoder(f.read())


def test_odd_texts_as_the_library(encoder, library):
    rng = random.Random(3)
    for _ in range(3_000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 20)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids, repr(text)
        assert word_bpe.decode(encoder.model, ids) == library.decode(ids, skip_special_tokens=False)


def test_every_kind_of_character(encoder, library):
    for c in [*range(0x3000), *range(0x3000, 0x110000, 97)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b"
            assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids, (hex(c), unicodedata.category(chr(c)))


@pytest.mark.parametrize("text", ["x" * 40_000, "ab" * 20_000, "é" * 5_000, "the" * 9_000, "'s" * 4_000])
def test_long_words_are_whole(encoder, library, text):
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 3)
    monkeypatch.setattr(word_bpe, "LONGEST_REMEMBERED", 4)
    encoder.seen.clear()
    for text in ["one two three four five six seven", "seven one longerword two longerword", "a a a"] * 2:
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_rows(spark, docs, texts, no_docs, library):
    got = word_bpe.encoded(docs, ["doc_id", "text"], queries.word_model()).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert word_bpe.encoded(no_docs, ["doc_id"], queries.word_model()).count() == 0


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError)):
        word_bpe.Model(b'{"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}')


def test_broken_utf8_is_read_with_marks(spark, library):
    df = spark.sql("SELECT 1 AS doc_id, cast(X'6162ff6364' AS string) AS text")
    assert word_bpe.encoded(df, ["doc_id"], queries.word_model()).first().ids == library.encode("ab�cd", add_special_tokens=False).ids
