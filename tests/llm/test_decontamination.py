import random
import re

from foliomine.llm import decontamination as dc


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def sh(ws, n):
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def brute(docs, items, n=5, percent=80):
    out = set()
    for d, text in docs:
        for i, item in items:
            ws = words(item)
            k = min(n, len(ws))
            if k and d is not None and i is not None:
                own = sh(ws, k)
                common = len(own & sh(words(text), k))
                if 100 * common >= percent * len(own):
                    out.add((d, i, len(own), common))
    return out


def test_equals_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 17, 40, 70])))) for i in range(60)]
    docs = []
    for d in range(150):
        ws = [word() for _ in range(rng.choice([0, 3, 50, 400]))]
        for _ in range(rng.randrange(3)):
            ps = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                ps[rng.randrange(len(ps))] = word()
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = [p.upper() + "," if rng.random() < 0.2 else p for p in ps]
        docs.append((d, " ".join(ws)))
    items += [(100, None), (101, "!!"), (None, "w1 w2")]
    docs += [(200, None), (201, ""), (None, docs[0][1])]
    got = dc.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    expected = brute(docs, items)
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 40


def test_supplied_passages_are_found_and_removed(spark, table):
    docs, items = table("documents", "sf0.01"), table("benchmark", "sf0.01")
    held = {
        d["doc_id"] for d in docs.collect() for i in items.collect()
        if i["text"].rstrip(".") and i["text"] in d["text"]
    }
    found = {r["doc_id"] for r in dc.find_leaks(docs, items).collect()}
    assert held and held <= found
    left = dc.remove_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - len(found)


def test_no_python_on_the_main_path(table):
    plan = dc.find_leaks(table("documents"), table("benchmark"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Cartesian" not in plan


def test_odd_rows(spark, documents, none, table):
    items = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (2, None, 3), (3, "word word word word word", 4)], "item_id long, text string, doc_id long")
    got = {tuple(r) for r in dc.find_leaks(documents, items).collect()}
    assert got == {(3, 1, 1, 1), (6, 3, 1, 1)}
    assert dc.find_leaks(none, items).count() == 0
    assert dc.find_leaks(documents, items.where("false")).count() == 0
    left = dc.remove_contaminated(documents, items)
    assert left.columns == documents.columns and left.where("doc_id is null").count() == 1


def test_a_document_that_holds_the_whole_benchmark(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(30))) for i in range(1500)]
    docs = [(0, " ".join(text for _, text in items)), (1, items[7][1]), (0, items[3][1])]
    got = dc.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, i) for i in range(1500)} | {(1, 7)}
    assert all(r["n_common"] == r["n_item"] for r in got)


def test_short_items_and_repeated_rows_by_the_sql_twin(spark, tmp_path):
    import duckdb

    from foliomine.llm.oracle import ORACLES

    docs = [(1, "One two three four five six"), (1, "One two three four five six"), (2, "three, four"), (3, "x"), (4, None)]
    items = [(1, "three four"), (2, "X"), (3, "two three four five six"), (4, "four three"), (5, ""), (6, "one two three")]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    db.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    expected = db.execute(ORACLES["op2_decontamination"]).fetchall()
    got = dc.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert sorted(map(tuple, got)) == sorted(expected) and len(got) == 5
