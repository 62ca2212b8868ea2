import json
import random

import pytest
from pyspark.sql import functions as F

from foliomine.operators import records as re, replies as rp, tables as tb
from foliomine.plans import inputs
from foliomine.sources import pages as pg


def now():
    return F.timestamp_seconds(F.lit(1_704_067_200))


def test_tables(spark):
    raw = [[["h1", "h2"], ["1", None]], [["", None], [""]], [["only"]], []]
    pages = spark.createDataFrame(
        [(1, 2, [[["late"], ["x"]]]), (1, 1, raw), (2, 1, [])],
        "doc_id int, page_no int, tables array<array<array<string>>>",
    )
    got = {r["doc_id"]: [(t["headers"], t["data"]) for t in r["tables"]] for r in tb.of_documents(pages).collect()}
    assert got == {1: [(["h1", "h2"], [["1", None]]), (["only"], []), (["late"], [["x"]])], 2: []}
    rows = sorted((r["doc_id"], r["page_no"], r["table_no"], r["row_no"], r["cells"]) for r in tb.table_rows(pages).collect())
    assert rows == [(1, 1, 0, 0, ["1", None]), (1, 1, 1, None, None), (1, 2, 0, 0, ["x"])]


def test_pages(spark, texts):
    lines = "\n".join(str(i) for i in range(95))
    made = pg.split_pages(texts(lines, "", "a\n"))
    got = {(r["doc_id"], r["page_no"]): r["text"] for r in made.collect()}
    assert [len(got[0, n].split("\n")) for n in (1, 2, 3)] == [40, 40, 15]
    assert got[1, 1] == "" and got[2, 1] == "a\n" and len(got) == 5
    assert {r["doc_id"]: r["text"] for r in pg.join_pages(made).collect()} == {0: lines, 1: "", 2: "a"}
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "")], "doc_id int, page_no int, text string")
    assert pg.join_pages(pages, skip_empty=True).first()["text"] == "a\n\nb"
    assert texts(lines).select(pg.first_page(F.col("text"))).first()[0] == "\n".join(map(str, range(40)))


REPLIES = [
    (0, json.dumps({"document_type": "invoice", "people": ["A"], "metadata": {"purpose": "pay"}, "text": "T"})),
    (1, "not json"), (2, "[1]"), (3, "{}"), (4, json.dumps({"people": None, "amounts": ["1"], "extra": 5})),
]


@pytest.fixture
def replies(spark):
    return rp.normalise(spark.createDataFrame(REPLIES, "doc_id bigint, reply string"))


def test_replies_get_defaults_or_an_error(replies):
    rows = {r["doc_id"]: r for r in replies.collect()}
    assert rows[0]["document_type"] == "invoice" and rows[0]["people"] == ["A"] and rows[0]["dates"] == []
    assert rows[1]["error"] == "Failed to parse AI response" and rows[1]["people"] is None
    assert rows[2]["error"] == "Failed to process AI response"
    assert rows[3]["document_type"] == "unknown" and rows[3]["metadata"] == {} and rows[3]["text"] == ""
    assert rows[4]["people"] == [] and rows[4]["amounts"] == ["1"]


def test_hints(evaluate):
    assert evaluate(rp.resolution_hint, "Quota exceeded", "boom") == [rp.HINT_QUOTA, rp.HINT_OTHER]


def test_requests_carry_the_whole_text_in_chunks(texts):
    long = "".join(chr(97 + i % 26) for i in range(9001))
    rows = rp.requests(texts(long, "", "short")).orderBy("doc_id", "chunk_no").collect()
    assert [(r["chunk_no"], r["n_chunks"], len(r["user_text"])) for r in rows] == [
        (1, 3, 4000), (2, 3, 4000), (3, 3, 1001), (1, 1, 5)
    ]
    assert "".join(r["user_text"] for r in rows[:3]) == long


def test_replies_with_text_for_numbers_and_bare_names(spark):
    sent = {"transactions": [{"amount": "12.5"}, {"amount": "?"}], "statement_details": {"opening_balance": "7"}}
    frame = spark.createDataFrame([(1, json.dumps(sent))], "doc_id int, reply string")
    row = rp.normalise_statement(frame).first()
    assert [t["amount"] for t in row["transactions"]] == [12.5, None]
    assert row["statement_details"]["opening_balance"] == 7.0
    frame = spark.createDataFrame([(1, '{"people": "Ann", "dates": ["a", "b"], "amounts": []}')], "doc_id int, reply string")
    row = rp.normalise(frame).first()
    assert (row["people"], row["dates"], row["amounts"]) == (["Ann"], ["a", "b"], [])


def test_all_pages_of_a_statement_are_read(texts):
    entries = [f"{i % 28 + 1:02d}.02.2024 Miete {i} -5,00" for i in range(100)]
    text = "\n".join([STATEMENT, *entries, "Hinweis: auf der letzten Seite 31.12.2024"])
    docs = texts(text).select(
        "*", pg.first_page(F.col("text")).alias("page_text"),
        F.lit("p").alias("path"), F.lit("c").alias("checksum"), F.current_timestamp().alias("modified_at"),
    )
    row = re.extract(docs, words=pg.words_from_text("page_text")).first()
    assert len(row["transactions"]) == 101 and row["pairs"]["Hinweis"] == "auf der letzten Seite 31.12.2024"
    assert len(row["entities"]["dates"]) == 102 and row["found_text"].endswith("31.12.2024")


def test_statement_replies(spark):
    full = {"account_info": {"holder": "H"}, "statement_details": {"opening_balance": 1.5},
            "transactions": [{"date": "2024-01-01", "amount": -2.0}, {"description": "x"}]}
    frame = spark.createDataFrame([(1, json.dumps(full)), (2, "{}"), (3, "bad")], "doc_id int, reply string")
    rows = {r["doc_id"]: r for r in rp.normalise_statement(frame).collect()}
    assert rows[1]["statement_details"]["opening_balance"] == 1.5 and len(rows[1]["transactions"]) == 2
    assert rows[2]["transactions"] == [] and rows[2]["account_info"] is None
    assert rows[3]["error"] == "Failed to parse AI response" and rows[3]["transactions"] is None
    assert rp.statement_transactions(rp.normalise_statement(frame)).count() == 2


STATEMENT = "Girokonto Nummer 7\nKontoauszug Januar 2024\nAlter Saldo 1,00 Euro\n01.02.2024 Miete -5,00\nMandat: M1"


@pytest.fixture
def documents(texts):
    docs = texts("plain 2024-01-02", "bad $5", "list", "empty reply", "amount $7", STATEMENT, "")
    return inputs.with_layout(docs).select(
        "*", F.lit("p").alias("path"), F.sha2("text", 256).alias("checksum"), now().alias("modified_at"),
        F.array(F.array(F.array(F.lit("h")), F.array(F.lit("v")))).alias("tables"),
    )

def test_cascade(documents, replies):
    extracted = re.extract(re.with_replies(documents, replies))
    rows = {r["doc_id"]: r["record"] for r in re.assemble(extracted, now(), "1").collect()}
    assert len(rows) == 7
    ai = rows[0]
    assert ai["processing"]["method"] == "ai" and ai["doc_info"]["type"] == "invoice"
    assert ai["doc_info"]["purpose"] == "pay" and ai["content"]["text"] == "T"
    assert ai["content"]["entities"]["people"] == ["A"]
    assert ai["content"]["entities"]["dates"] == ["2024-01-02"]  # kept where the reply has none
    assert ai["content"]["tables"][0]["headers"] == ["h"]
    for doc in (1, 2):
        assert rows[doc]["processing"]["method"] == "traditional"
        assert rows[doc]["processing"]["fallback_reason"]["error_type"] == "AIProcessingError"
    assert rows[1]["content"]["entities"]["amounts"] == ["$5"]
    assert rows[3]["processing"]["method"] == "ai" and rows[3]["content"]["text"] == "empty reply"
    assert rows[4]["content"]["entities"]["amounts"] == ["1"]
    bank = rows[5]
    assert bank["processing"]["branch"] == "template" and bank["doc_info"]["type"] == "bank_statement"
    assert bank["processing"]["reason"] == "OpenAI client not configured"
    assert bank["doc_info"]["statement_details"]["opening_balance"] == 1.0
    assert [(t["date"], t["amount"], t["mandate"]) for t in bank["content"]["transactions"]] == [("2024-02-01", -5.0, "M1")]
    assert bank["fields"] == {"account_number": "7", "statement_period": "Januar 2024"}
    assert bank["content"]["key_value_pairs"]["Mandat"] == "M1"
    assert rows[6]["processing"]["reason"] == "No text content available"


def test_records_without_replies_write_as_json(spark, documents, tmp_path):
    out = str(tmp_path / "records")
    re.write_json(re.assemble(re.extract(documents), now(), "1"), out)
    back = {r["doc_id"]: r["record"] for r in spark.read.json(out).collect()}
    assert len(back) == 7 and back[0]["processing"]["method"] == "traditional"
    assert back[0]["processing"]["branch"] == "basic" and back[0]["doc_info"]["type"] == "unknown"


def merged(spark, rows, **options):
    replies = spark.createDataFrame(rows, "doc_id bigint, chunk_no int, reply string")
    return {r["doc_id"]: r for r in rp.merge(rp.normalise(replies), **options).collect()}


def test_replies_to_chunks_become_one(spark):
    part = lambda **fields: json.dumps(fields)
    rows = [
        (1, 10, part(text="c", people=["B", "C"], metadata={"x": "3", "purpose": "last"}, document_type="late")),
        (1, 2, part(text="b", people=["A", "B"], metadata={"x": "2", "y": "2"}, document_type="letter")),
        (1, 1, part(text="a", people=["A"], metadata={"x": "1", "purpose": "first"})),
        (1, 3, "not json"),
        (1, 2, part(text="b", people=["A", "B"], metadata={"x": "2", "y": "2"}, document_type="letter")),  # sent again
        (2, 1, "[1]"), (2, 2, "not json"), (3, 5, "{}"),
    ]
    got = merged(spark, rows, separator="|")
    one = got[1]
    assert (one["document_type"], one["text"], one["people"]) == ("letter", "a|b|c", ["A", "B", "C"])
    assert one["metadata"] == {"x": "3", "y": "2", "purpose": "last"}
    assert (one["error"], one["n_parts"], one["n_failed"]) == (None, 4, 1)
    assert got[2]["error"] == rp.NOT_AN_OBJECT and got[2]["text"] is None and got[2]["n_failed"] == 2
    assert got[3]["document_type"] == "unknown" and got[3]["metadata"] == {} and got[3]["text"] == ""
    assert merged(spark, [r for r in rows if r[0] > 9]) == {}


def test_the_merge_is_a_fold_from_the_left(spark):
    rng = random.Random(8)
    rows, expected = [], {}
    for doc in range(40):
        parts = []
        for no in range(rng.randrange(1, 30)):
            fields = {
                "text": rng.choice(["", "x", "yz"]),
                "metadata": {rng.choice("abc"): str(rng.randrange(9)) for _ in range(rng.randrange(4))},
                "dates": [rng.choice("pqrs") for _ in range(rng.randrange(4))],
                "document_type": rng.choice(["unknown", "m", "n"]),
            }
            parts.append((doc, no, json.dumps(fields)))
            e = expected.setdefault(doc, {"text": "", "metadata": {}, "dates": [], "document_type": "unknown"})
            e["text"] += fields["text"]
            e["metadata"] |= fields["metadata"]
            e["dates"] += [d for d in dict.fromkeys(fields["dates"]) if d not in e["dates"]]
            if e["document_type"] == "unknown":
                e["document_type"] = fields["document_type"]
        rng.shuffle(parts)
        rows += parts
    got = merged(spark, rows)
    assert {d: {n: r[n] for n in e} for (d, e) in expected.items() for r in [got[d]]} == expected


def test_a_document_with_chunked_replies_stays_one_row(spark, texts):
    replies = rp.normalise(spark.createDataFrame([(0, 1, '{"text": "a"}'), (0, 2, '{"text": "b"}')], "doc_id bigint, chunk_no int, reply string"))
    rows = re.with_replies(texts("whole", "other"), replies).orderBy("doc_id").collect()
    assert [r["reply"] and r["reply"]["text"] for r in rows] == ["ab", None]
