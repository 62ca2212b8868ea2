import random
import re

import numpy as np

from foliomine.llm import words as w


def test_words_are_runs_between_ascii_white_space():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("ab \t\n\r\x0b é\U0001f600") for _ in range(rng.randint(0, 30)))
        data = w.as_bytes(text)
        got = [bytes(data[a:b]).decode() for a, b in zip(*w.spans(data))]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_equal_words_and_only_those_have_equal_hashes():
    text = " ".join(f"w{i % 500}" for i in range(3000)) + " ab ba aab aba baa"
    hashes = w.word_hashes(text)
    by_word = dict(zip(text.split(), hashes))
    assert [by_word[x] for x in text.split()] == list(hashes)
    assert len(set(by_word.values())) == len(by_word)


def test_ngrams_depend_on_order_and_length():
    a, b = w.word_hashes("x y z"), w.word_hashes("z y x")
    assert w.ngram_hashes(a, 3) != w.ngram_hashes(b, 3)
    assert len(w.ngram_hashes(a, 4)) == 0
    assert not np.intersect1d(w.ngram_hashes(a, 1), w.ngram_hashes(a, 2)).size


def test_shingle_set_folds_ascii_letters_alone():
    assert np.array_equal(w.shingle_set("A b C", 3), w.shingle_set("a\nB c", 3))
    assert not np.array_equal(w.shingle_set("É b", 2), w.shingle_set("é b", 2))
    assert len(w.shingle_set("one two", 3)) == 1
    assert len(w.shingle_set(None, 3)) == len(w.shingle_set(" ", 3)) == 0


def test_windows_change_no_hash_of_a_word_that_fits(monkeypatch):
    rng = random.Random(6)
    text = " ".join("x" * rng.randrange(1, 30) + str(rng.randrange(9)) for _ in range(400))
    whole = w.word_hashes(text)
    monkeypatch.setattr(w, "WINDOW", 64)
    assert np.array_equal(w.word_hashes(text), whole)
    long = w.word_hashes("y" * 200 + " " + "y" * 200 + " a " + "y" * 201 + " z" + "y" * 199)
    assert long[0] == long[1] and len(set(long.tolist())) == 4
