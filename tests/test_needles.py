import random
import re

import pytest
from pyspark.sql import functions as F

from foliomine.functions import categories as fc
from foliomine.operators import categories as ca, needles as nd, templates as tp
from foliomine.sources import keywords as kw, templates as ts


def test_every_text_meets_the_needles_it_holds(spark, texts):
    rng = random.Random(2)
    word = lambda a, b: "".join(rng.choice("abcé ß") for _ in range(rng.randrange(a, b)))
    said = [word(0, 30) for _ in range(200)]
    wanted = sorted({word(1, 6) for _ in range(120)})
    asked = spark.createDataFrame([(w, [w]) for w in wanted], "needle string, pieces array<string>")
    rows = nd.candidates(texts(*said).withColumnRenamed("doc_id", "text_id"), asked)
    found = {(r["text_id"], r["needle"]) for r in rows.collect()}
    held = {(i, w) for i, t in enumerate(said) for w in wanted if w in t}
    assert held <= found and len(found) < 200 * len(wanted) / 2 and rows.count() == len(found)


def test_the_first_needle_inside_each_text(spark, texts):
    """In-row search by lookups and patterns, against a plain search; ranks are in any order of
    lengths, and needles hold, begin with and overlap one another."""
    rng = random.Random(9)
    word = lambda signs, a, b: "".join(rng.choice(signs) for _ in range(rng.randrange(a, b)))
    ranked = list({word("abcé", 2, 6) for _ in range(150)} | {"b c", "a\tb", "é.", "😀b", "|(", "x" * 100, "b c d"})
    rng.shuffle(ranked)
    said = [" ".join(word("abcdé.", 0, 9) for _ in range(rng.randrange(6))) for _ in range(300)]
    said += ["", " ", "zz", "a😀bc", "(|(", "x" * 101, "ab c dab", "a\tb", "ab\ncé.", None]
    for some in (ranked, ranked[:9], ranked[:1], []):
        got = nd.with_first(texts(*said), F.col("text"), some, "text_id")
        assert got.columns == ["doc_id", "text", "text_id"]
        least = lambda t: min((i for i, w in enumerate(some) if w in (t or "")), default=len(some))
        assert {r["doc_id"]: r["text_id"] for r in got.collect()} == {i: least(t) for i, t in enumerate(said)}


def test_few_keywords_move_no_lines(spark, texts):
    """The category is found inside the row; a table beyond the limits of this is joined."""
    rows = texts("die Miete", "x").withColumnRenamed("text", "description")
    schema = "category string, priority int, keyword string"
    few = spark.createDataFrame(KEYWORDS, schema)
    found = ca.categorise(rows, few)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    long = few.unionByName(spark.createDataFrame([("l", 9, "y" * 101)], schema))
    assert "Join" in ca.categorise(rows, long)._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.collect()) == sorted(ca.categorise(rows, long).collect())


KEYWORDS = [("a", 2, "miete"), ("b", 1, "REWE"), ("b", 1, "x"), ("c", 1, "rewe"), ("d", 3, "ät"), ("e", None, "ganz früh"), ("f", 1, None), ("a", 0, "miete früh")]


def test_keyword_table_equals_the_keyword_lists(spark, texts):
    table = spark.createDataFrame(KEYWORDS, "category string, priority int, keyword string")
    rng = random.Random(4)
    parts = ["Miete", "rewe", "x", "ÄT", " ", "ganz früh", "früh", "y", "Miete früh", ""]
    said = ["".join(rng.choice(parts) for _ in range(rng.randrange(5))) for _ in range(300)] + [None]
    rows = texts(*said).withColumnRenamed("text", "description").withColumn("needle", F.lit(1)).withColumn("text_id", F.lit("t"))
    got = ca.categorise(rows, table)
    assert got.columns == [*rows.columns, "category"] and got.count() == len(said)
    lists = kw.keywords_from(table)
    expected = rows.select("doc_id", fc.category(F.col("description"), lists).alias("c")).collect()
    assert {r["doc_id"]: r["category"] for r in got.collect()} == {r["doc_id"]: r["c"] for r in expected}
    assert "other" in {r["c"] for r in expected} and len({r["c"] for r in expected}) >= 5
    assert {r["category"] for r in ca.categorise(rows, table.where("false")).collect()} == {"other"}


@pytest.mark.parametrize(
    "regex, pieces",
    [
        (r"Alter\s+Saldo\s+([\d.,]+)\s*Euro", ["alter", "saldo", "euro"]),
        (r"a|b", []), (r"x(a|b)y", ["x", "y"]), (r"(?i)abc", []), (r"(?:abc)+d", ["d"]), (r"ab?c", ["a", "c"]),
        (r"ab+c", ["a", "c"]), (r"ab{2,3}c", ["a", "c"]), (r"\x41bcBd", ["bcbd"]), (r"^K.nto$", ["k", "nto"]),
        (r"[^\]]x[a-z&&[^b]]", []), (r"\Qa|b\E", []), (r"(a(b(c)))d\.e", ["d", "e"]), (r"\p{Lu}bc\1d", ["bc", "d"]),
        (r"STRAẞE İſK", ["straße isk"]), ("", []),
    ],
)
def test_required_pieces(evaluate, regex, pieces):
    assert evaluate(tp.required_pieces, regex) == [pieces]


def test_template_table_equals_the_templates(spark):
    rng = random.Random(6)
    pool = [r"Konto\s+Nr", r"\d{3}", "Saldo", r"A|B", r"st?raße", r"(x|y)z", r"[Qq]uer", "ı", r"Sa?ldo"]
    templates = [
        ts.Template(
            name=f"t{i}",
            identifiers=rng.sample(pool, rng.randrange(1, 4)),
            zones=[],
            fields={"total_x": r"Saldo\s+([\d.,]+)", f"k{i}": rng.choice([r"Nr\s+(\w+)", r"(\d{3})"])},
        )
        for i in range(25)
    ]
    words = ["Konto  Nr 7", "konto", "SALDO 1.012,34 EUR", "123", "A", "straße", "sraße", "xz", "Quer", "I", "Sldo", "\n"]
    said = [" ".join(rng.choice(words) for _ in range(rng.randrange(8))) for _ in range(150)] + [None]
    docs = spark.createDataFrame([(i, t, t, 1) for i, t in enumerate(said)], "doc_id int, page_text string, text string, n int")
    table = ts.template_rows(spark, templates)
    got = tp.fields_from(tp.classify_from(docs, table), table)
    expected = tp.classify(docs, templates).withColumn("fields", tp.fields("text", templates))
    shown = lambda df: {r["doc_id"]: (r["doc_type"], r["score"] or 0, sorted(map(tuple, r["fields"] or []))) for r in df.collect()}
    assert got.columns == ["doc_id", "page_text", "text", "n", "doc_type", "score", "fields"]
    assert shown(got) == shown(expected) and len({v[0] for v in shown(got).values()}) > 5


def test_ten_thousand_templates(spark):
    rows = spark.range(10_000).selectExpr(
        "cast(id as int) as template_no", "concat('t', id) as name",
        r"array(concat('Vertrag\\s+', lpad(id, 6, '0'), '\\b')) as identifiers",
    ).withColumn("zones", F.array()).withColumn("fields", F.array())
    docs = spark.range(0, 10_000, 25).selectExpr("id as doc_id", "concat('Zum VERTRAG  ', lpad(id, 6, '0'), ' gilt') as page_text")
    got = tp.classify_from(docs, rows)
    assert got.where("doc_type = concat('t', doc_id) and score = 1").count() == 400


def test_few_needles_come_to_the_texts(spark, texts):
    """Texts aren't shuffled gram by gram: the index of few needles is a local table."""
    asked = spark.createDataFrame([("miete", ["miete"])], "needle string, pieces array<string>")
    rows = nd.candidates(texts("die miete", "x").withColumnRenamed("doc_id", "text_id"), asked)
    assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [(r["text_id"], r["needle"]) for r in rows.collect()] == [(0, "miete")]


def test_many_needles_have_long_grams_of_known_forms(spark, texts):
    """Numbers that share all their short grams meet only the texts that hold them."""
    rng = random.Random(3)
    numbers = [f"kunde#{n:09d}" for n in rng.sample(range(10**6), 300)] + ["ab", "ü-7", "7", "konto nr 12345"]
    said = [f"von {rng.choice(numbers)} an {rng.choice(numbers)}; {rng.randrange(10**7)}" for _ in range(150)]
    asked = spark.createDataFrame([(w, [w]) for w in numbers], "needle string, pieces array<string>")
    rows = nd.candidates(texts(*said).withColumnRenamed("doc_id", "text_id"), asked, few=10).collect()
    found = {(r["text_id"], r["needle"]) for r in rows}
    held = {(i, w) for i, t in enumerate(said) for w in numbers if w in t}
    assert held <= found and len(found) == len(rows) <= len(held) + 150


def test_the_first_template_of_a_name_gives_the_fields(spark):
    rows = [(no, "t", [], [], [("k", regex)]) for no, regex in ((2, "(b)"), (1, "(a)"))]
    docs = spark.createDataFrame([(1, "t", "ab")], "doc_id int, doc_type string, text string")
    got = tp.fields_from(docs, spark.createDataFrame(rows, ts.TEMPLATE_ROW)).collect()
    assert [[tuple(f) for f in r["fields"]] for r in got] == [[("k", "a")]]
