import zlib

from pyspark.sql import functions as F

from foliomine.llm import sharding as sh
from foliomine.llm.ordering import numbered, running_total


def check_law(rows, texts, n_shards):
    counts = {}
    for r in rows:
        counts.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(counts.get(j, [])) for j in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in counts.values())
    assert {r["law"] for r in rows} <= {"rows"} and all(r["grown_shard"] is None for r in rows)
    for r in rows:
        data = (texts.get(r["doc_id"]) or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))


def test_equal_texts_meet_and_counts_are_even(table):
    docs = table("documents", "sf0.01")
    rows = sh.shard_documents(docs, 40).join(docs.select("doc_id", "text"), "doc_id").collect()
    check_law(rows, {r["doc_id"]: r["text"] for r in rows}, 40)
    groups = {}
    for r in rows:
        groups.setdefault(r["text"], set()).add(r["shard"])
    assert sum(len(g) > 1 for g in groups.values()) == 0


def test_a_group_larger_than_a_shard_is_split_over_few_shards(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sh.shard_documents(docs, 30).collect()
    check_law(got, dict(rows), 30)
    used = [r["shard"] for r in got if r["doc_id"] % 3 == 0]
    assert len(set(used)) <= 16  # ten shards' worth of rows, of thirty at the start


def test_propagation_keeps_quotas_and_lowers_the_cut(spark):
    rows = [(f"g{i}", h, h, 1 + i % 3) for i in range(400) for h in {i % 10, (i * 7) % 10, (i // 10) % 10}]
    parts = spark.createDataFrame(rows, "`group` string, home int, shard int, n long")
    quota = [sum(r[3] for r in rows) // 10 + 40] * 10
    moved = sh.propagate(parts, quota).collect()
    assert sorted((r["group"], r["home"], r["n"]) for r in moved) == sorted((g, h, n) for g, h, _, n in rows)
    load, shards = [0] * 10, {}
    for r in moved:
        load[r["shard"]] += r["n"]
        shards.setdefault(r["group"], set()).add(r["shard"])
    before = [sum(n for _, _, s, n in rows if s == j) for j in range(10)]
    assert all(x <= max(q, b) for x, q, b in zip(load, quota, before))
    assert sum(map(len, shards.values())) < 0.6 * len(rows)


def test_odd_rows(documents, none):
    got = sh.shard_documents(documents, 4).collect()
    assert len(got) == documents.count()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    check_law(got, texts, 4)
    assert sh.shard_documents(none, 4).count() == 0


def test_numbers_and_running_totals(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("v"))
    got = numbered(rows, "k", "id").orderBy("row_no").collect()
    assert [r["row_no"] for r in got] == list(range(1000))
    assert [(r["k"], r["id"]) for r in got] == sorted((i % 3, i) for i in range(1000))
    total = 0
    for r in running_total(rows, "v", "k", "id").orderBy("k", "id").collect():
        assert r["before"] == total
        total += r["v"]
