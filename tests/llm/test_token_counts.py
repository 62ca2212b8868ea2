import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliomine.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "'", "s", "ll", "T", "É", "é", "é", "́", "ß", "Σ", "ς", "İ", "i̇", "<|endoftext|>", "<|", "|>",
    "<", " ", "  ", "\n", "\x0b", "\x0c", "\r\n", "\x1c", "\x1f", "\x00", "\x7f", "\x85", "\xa0", " ", "　",
    "​", "1", "22", "½", "²", "ª", "µ", "×", "÷", "Ａ", "漢字", "ᄀ", "ᅡ", "가", "\U0001f600", "﻿", "ǅ", "ﬁ",
    "Å", "Ω", "%", "#", "…", "’", "“", "€", "ñ", "À", "ẞ", "word", "DON'T", "’s", "\xad", "",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def encoder():
    return tc.Encoder(tc.read_tokenizer(PATH))


def test_hostile_texts(library, encoder):
    rng = random.Random(3)
    for _ in range(8000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14)))
        assert encoder.count(text, {}) == library(text), text


def test_every_plain_character_between_letters(library, encoder):
    for code in [*range(0x250), 0x2013, 0x2018, 0x2019, 0x201C, 0x2026, 0x20AC, 0x3BC]:
        text = f"a{chr(code)}b {chr(code)}{chr(code)}́ C'{chr(code)}"
        assert encoder.count(text, {}) == library(text), hex(code)


def test_long_texts_are_cut_at_white_space(library, encoder, monkeypatch):
    monkeypatch.setattr(tc, "SLICE", 50)
    rng = random.Random(5)
    text = "".join(rng.choice(PARTS) * rng.randrange(1, 4) for _ in range(3000)) + "x" * 500
    assert len(list(tc._slices(text))) > 20 and "".join(tc._slices(text)) == text
    assert encoder.count(text, {}) == library(text)


def test_the_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tc, "CACHE", 10)
    encoder = tc.Encoder(tc.read_tokenizer(PATH))
    texts = [f"w{i} some words {i}" for i in range(50)]
    assert [encoder.count(t, {"some": 1}) for t in texts] == [library(t) for t in texts]
    assert len(encoder.cache) < 20


def test_the_table_changes_no_count(spark, table, library):
    rows = table("documents")
    expected = {r["doc_id"]: library(r["text"]) for r in rows.collect()}
    for sample in (1, 2048):
        got = tc.count_tokens(rows, tc.Settings(PATH, sample_docs=sample)).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == expected and len(got) == rows.count()
        assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    sizes = {r["doc_id"]: len((r["text"] or "").encode()) for r in rows.collect()}
    assert {r["doc_id"]: r["n_bytes"] for r in got} == sizes


def test_odd_rows(documents, none, library):
    got = tc.count_tokens(documents, tc.Settings(PATH, max_tokens=2)).collect()
    texts = [r["text"] for r in documents.collect()]
    counts = sorted((len((t or "").encode()), library(t), library(t) > 2) for t in texts)
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == counts
    assert sum(r["doc_id"] is None for r in got) == 1
    empty = tc.count_tokens(none, tc.Settings(PATH))
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and empty.count() == 0


def test_counting_shuffles_nothing(documents):
    plan = tc.count_tokens(documents, tc.Settings(PATH))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="differ from the supported"):
        tc.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
