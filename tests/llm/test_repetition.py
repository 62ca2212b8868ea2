import collections
import random
import re

from foliomine.llm import repetition as rp


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {
        j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)
    }
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return [len(words), sum(map(len, words)), symbols, lines, len(covered)]


def test_counts_equal_brute_force():
    rng = random.Random(2)
    for _ in range(600):
        text = "".join(
            rng.choice(["a ", "b ", "c ", "\n", "é# ", "x<y>", "\t", "\r\n", "\U0001f600 "])
            for _ in range(rng.randint(0, 60))
        )
        assert rp.measure(text)[:5] == brute(text), text


def test_characters_inside_repeated_ngrams_count_once():
    m = dict(zip(rp.MEASURES, rp.measure("aa b c d e " * 3 + "zz")))
    assert m["dup5_chars"] == 18 and m["n_repeat_words"] == 15 and m["dup10_chars"] == 18
    assert m["top2_chars"] == 9 and m["word_chars"] == 20
    m = dict(zip(rp.MEASURES, rp.measure("one two\none two\nthree")))
    assert m["n_dup_lines"] == 1 and m["dup_line_chars"] == 6


def test_clean_documents_stay_and_repetitive_ones_go(spark, table):
    rows = rp.check_repetition(table("documents", "sf0.01")).join(table("labels", "sf0.01"), "doc_id")
    clean = rows.where("quality = 1 and not base_failed")
    assert clean.where("not kept").count() == 0 and clean.count() > 200
    docs = spark.createDataFrame([(1, "spam and eggs " * 40), (2, "in this text no words of any kind come twice at all")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in rp.check_repetition(docs).collect()} == {1: False, 2: True}


def test_odd_rows(documents, none):
    got = {r["doc_id"]: r for r in rp.check_repetition(documents).collect()}
    assert [got[i]["base_failed"] for i in (0, 1, 2, 3)] == [True] * 4
    assert got[6]["n_words"] == 30000 == got[6]["n_repeat_words"] and not got[6]["kept"]
    assert rp.check_repetition(documents).count() == documents.count()
    assert rp.check_repetition(none).count() == 0
