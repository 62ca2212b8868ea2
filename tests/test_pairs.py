import random
import re

from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from foliomine.operators import pairs as pa

PLAIN = [
    r"([A-Za-zäöüÄÖÜß\s]+):\s*([^\n]+)",
    r"([A-Za-zäöüÄÖÜß\s]+)\s+(\d[\d\s.,]+(?:EUR|€)?(?:\s*p\.a\.)?)",
]


def expected(text):
    found = {}
    for regex in PLAIN:
        for match in re.finditer(regex, text):
            key, value = match.group(1).strip(), match.group(2).strip()
            if key and value and len(key) > 2:
                found[key] = value
    return found


def random_texts(n):
    pieces = ["Saldo", "ab", "Zins p", ":", "\n", "\n\n", " ", "  ", "12", "3,5", "EUR", "€", "p.a.", "x", "Größe", "-", " "]
    rng = random.Random(7)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_pairs_are_those_of_the_plain_patterns(spark, texts):
    values = random_texts(3000) + ["", "Key: a\nKey: b", "Saldo 12,50 EUR p.a.", "ab 1", "Konto\nNummer: 7"]
    got = {}
    for row in pa.pair_rows(texts(*values), text="text").collect():
        got.setdefault(row["doc_id"], {})[row["key"]] = row["value"]
    for i, text in enumerate(values):
        assert got.get(i, {}) == expected(text), repr(text)


def test_pairs_of_a_long_text_without_digits_take_linear_time(spark, texts):
    rows = pa.pair_rows(texts("wort " * 40_000, "wort " * 40_000 + "Ende: 5"), text="text").collect()
    assert [r["value"] for r in rows] == ["5"]


def test_map_form(spark, texts):
    made = texts("Key: a\nKey: b\nOther: c").select(pa.pair_map(F.col("text")).alias("m"))
    assert made.first()["m"] == {"Key": "b", "Other": "c"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB :\n12,.€", max_size=40))
def test_run_forms_equal_the_plain_patterns_in_python(text):
    # \G has no Python form; a search loop that starts each time at the last end stands for it.
    for ours, plain in ((pa.KEY_COLON_VALUE, PLAIN[0]), (pa.KEY_AMOUNT, PLAIN[1])):
        body = ours.replace(pa._RUN, "")
        free = re.compile(r"(?<![A-Za-zäöüÄÖÜß\s])" + body)
        at_end = re.compile(body)
        found, end = [], 0
        while True:
            match = at_end.match(text, end) or free.search(text, end)
            if not match:
                break
            found.append((match.group(1).strip(), match.group(2)))
            end = match.end()
        assert found == [(m.group(1).strip(), m.group(2)) for m in re.finditer(plain, text)]
