import datetime
import random
import re

from pyspark.sql import functions as F

from foliomine.functions import categories, entities as en, text as tx
from foliomine.functions.text import WHITESPACE
from foliomine.sources.keywords import keywords_from
from foliomine.sources.templates import BUILTIN_TEMPLATES


def test_whitespace_is_what_python_strips(evaluate):
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    values = ["  a b\t", " x \n", "", "　"]
    assert evaluate(tx.strip, *values) == [v.strip() for v in values]


def test_german_amounts(evaluate):
    values = ["1.012,34", "-5,00 EUR", "12 €", "1,234.56", "1,2,3", "", ".", "abc", "7"]
    assert evaluate(tx.german_amount, *values) == [1012.34, -5.0, 12.0, 1.23456, 0.0, 0.0, 0.0, 0.0, 7.0]
    assert evaluate(tx.german_amount_or_null, "1.012,34", "1,2,3", None) == [1012.34, None, None]
    assert evaluate(tx.german_cents, "-1.012,34", "0,1", "x") == [-101234, 10, None]


def test_dates(evaluate):
    values = ["01.02.2024", "1.2.2024", "31.02.2024", "Januar 2024", "1.2", " 3 . 4 . 2024 ", "100.2.24"]
    assert evaluate(tx.iso_date, *values) == [
        "2024-02-01", "2024-02-01", "2024-02-31", "Januar 2024", "1.2", "2024-04-03", "24-02-100",
    ]
    assert evaluate(tx.checked_date, "29.02.2024", "31.02.2024", "x") == [
        datetime.date(2024, 2, 29), None, None,
    ]


def test_pattern_folds_case_and_spaces_like_python(evaluate):
    regex = r"eingeräumte\s+(\d+)$"
    text = "EINGERÄUMTE 12\nx\r\nEingeräumte   7\nEingeräumte 8\r"
    found = evaluate(lambda c: tx.all_matches(c, tx.pattern(regex, True, True), 1), text)[0]
    assert found == [m.group(1) for m in re.finditer(regex, text, re.I | re.M)]


def test_missing_group_is_null(evaluate):
    assert evaluate(lambda c: tx.first_match(c, r"a(b)?", 1), "a", "ab", "x") == [None, "b", None]
    assert evaluate(lambda c: tx.last_match(c, r"a(.)", 1), "ab ac", "x") == ["c", None]


def test_entities_keep_pattern_order_and_duplicates(evaluate):
    text = "03/04/2024 2024-01-02 05.06.2024 2024-01-02 $ 5 USD €1,000.50 7 EUR"
    assert evaluate(en.dates, text) == [["2024-01-02", "2024-01-02", "05.06.2024", "03/04/2024"]]
    assert evaluate(en.amounts, text)[0] == [
        m.group() for p in en.AMOUNT_PATTERNS for m in re.finditer(p, text)
    ]
    assert "$ 5" in evaluate(en.amounts, text)[0] and "5 USD" in evaluate(en.amounts, text)[0]
    basic = "$5 EUR and $6.50 on 2024-01-02 or 02.01.2024"
    assert evaluate(en.basic_amounts, basic) == [["$5 EUR", "$6.50"]]
    assert evaluate(en.basic_dates, basic) == [["2024-01-02"]]


def test_any_entity(evaluate):
    found = lambda c: en.any_entity(en.entities(en.dates(c), en.amounts(c)))
    assert evaluate(found, "on 2024-01-02", "nothing", None) == [True, False, False]


def test_categories_follow_their_order(evaluate):
    values = ["Miete Wohnung", "Labor GmbH", "GASTHAUS", "Flug LH", "Überweisung", "Tee", "uber gas"]

    def expected(text):
        text = text.lower()
        for name, words in categories.CATEGORY_KEYWORDS.items():
            if any(w in text for w in words):
                return name
        return "other"

    assert evaluate(categories.category, *values) == [expected(v) for v in values]
    own = {"drinks": ["tee", "kaffee (bar)"]}
    assert evaluate(lambda c: categories.category(c, own), "Kaffee (Bar)", "Miete") == ["drinks", "other"]


def test_keywords_from_a_table(spark, evaluate):
    table = spark.createDataFrame(
        [("b", 2, "Tee"), ("a", 1, "x"), ("b", 2, "Kaffee"), ("a", 5, "tee z")],
        "category string, priority int, keyword string",
    )
    own = keywords_from(table)
    assert own == [("a", ["x"]), ("b", ["kaffee", "tee"]), ("a", ["tee z"])]
    assert evaluate(lambda c: categories.category(c, own), "TEE x", "tee z", "") == ["a", "b", "other"]
    assert evaluate(lambda c: categories.category(c, keywords_from(table.where("false"))), "x") == ["other"]


def test_letters_of_all_cases(spark):
    """The class written out holds what Java takes for the letters where case is ignored."""
    signs = spark.createDataFrame([(chr(i),) for i in range(0x11000) if not 0xD800 <= i < 0xE000], "c string")
    folded = {r["c"] for r in signs.where(F.col("c").rlike("(?Udi)" + tx.LETTERS)).collect()}
    assert folded == {r["c"] for r in signs.where(F.col("c").rlike(tx.ALL_CASES)).collect()} > set("aZäſ")


def test_faster_patterns_find_the_same(spark):
    """Whole runs, starts of runs and classes without folding, against the patterns as given."""
    rng = random.Random(5)
    said = ["".join(rng.choice(["a", "B", "ä", "K", "ſ", " ", "  ", "\n", "\r", "1", "12345 x", ".", "É"]) for _ in range(rng.randrange(40))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    given = {p for t in BUILTIN_TEMPLATES for p in [*t.fields.values(), *(q for z in t.zones for q in z.patterns)] if tx.LETTERS in p}
    given |= {rf"({tx.LETTERS}+\s+\d)", rf"({tx.LETTERS}+\s+b|\d)", rf"a({tx.LETTERS}+)\s*\n", rf"\s+{tx.LETTERS}"}
    for regex in sorted(given):
        for ignore_case in (True, False):
            plain = "(?Ud" + "i" * ignore_case + "m)" + regex
            found = rows.select("t", tx.all_matches(F.col("t"), plain).alias("a"), tx.all_matches(F.col("t"), tx.pattern(regex, ignore_case, True)).alias("b")).collect()
            assert all(r["a"] == r["b"] for r in found), regex
            assert regex.startswith("Konto") or any(r["a"] for r in found), regex


def test_texts_without_a_needed_sign_are_not_searched(evaluate):
    said = ["", "12.01.2024", "2024-01-31 1/2", "01/02/2024", "$ 5 €7", "7 EUR, 8 USD", "9 €", "5 Euro - a.b/c", None]
    for found, patterns in ((en.dates, en.DATE_PATTERNS), (en.amounts, en.AMOUNT_PATTERNS), (en.basic_amounts, [en.BASIC_AMOUNT_PATTERN])):
        assert evaluate(found, *said) == [None if t is None else [m for p in patterns for m in re.findall(p, t)] for t in said]
