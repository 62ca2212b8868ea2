import pytest
from pyspark.sql import functions as F

from foliomine.operators import catalog as ca
from foliomine.schema import CATALOG

FIELDS = "checksum string, name string, size bigint, path string, mime_type string, created_s bigint, batch_no bigint"


@pytest.fixture
def make(spark):
    def rows(*values):
        frame = spark.createDataFrame(list(values), FIELDS)
        return ca.catalog_rows(frame.withColumn("created_at", F.timestamp_seconds("created_s")))

    return rows


def entry(checksum, path, created, batch=0, size=1):
    return (checksum, path.split("/")[-1], size, path, "text/plain", created, batch)


def keys(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def test_upsert_keeps_the_newest_row_per_key(make):
    current = make(entry("c1", "a", 1), entry("c1", "b", 1))
    batch = make(entry("c1", "a", 5, 1), entry("c2", "a", 5, 1))
    merged = ca.upsert(current, batch)
    assert merged.columns == CATALOG.fieldNames()
    got = merged.select("checksum", "path", F.unix_seconds("created_at").alias("s"))
    assert keys(got, "checksum", "path", "s") == [("c1", "a", 5), ("c1", "b", 1), ("c2", "a", 5)]
    again = ca.upsert(merged, batch)
    assert keys(again, "file_id", "batch_no") == keys(merged, "file_id", "batch_no")
    assert keys(ca.latest_by_path(merged), "checksum", "path") in (
        [("c1", "a"), ("c1", "b")], [("c1", "b"), ("c2", "a")],
    )


def test_equal_times_are_settled_by_batch(make):
    both = make(entry("c", "a", 1, 2, 9), entry("c", "a", 1, 1, 8))
    assert keys(ca.newest_per_key(both), "size") == [(9,)]


def test_a_key_with_a_third_of_all_rows(spark, make):
    many = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("checksum"),
        F.lit("n").alias("name"), F.lit(1).alias("size"), F.lit("p").alias("path"),
        F.lit("t").alias("mime_type"), F.timestamp_seconds("id").alias("created_at"), F.lit(0).alias("batch_no"),
    )
    rows = ca.newest_per_key(ca.catalog_rows(many))
    assert rows.count() == 20_001
    hot = rows.where("checksum = 'hot'").select(F.unix_seconds("created_at")).first()
    assert hot[0] == 29_997
    # Rows of one key are combined before they are shuffled.
    assert "partial_max" in rows._jdf.queryExecution().executedPlan().toString()


def test_lookup_search_statistics(make):
    files = make(entry("c1", "x/Report_1.txt", 1), entry("c1", "y/copy.txt", 2), entry("c2", "x/b.txt", 3, 0, 40))
    some_id = files.where("path = 'x/b.txt'").first()["file_id"]
    assert keys(ca.public(ca.by_id(files, some_id)), "path") == [("x/b.txt",)]
    assert keys(ca.by_checksum(files, "c1"), "path") == [("x/Report_1.txt",)]
    assert [r["path"] for r in ca.search(files, "x/").collect()] == ["x/b.txt", "x/Report_1.txt"]
    assert keys(ca.search(files, "REPORT"), "path") == [("x/Report_1.txt",)]
    assert keys(ca.search(files, "r_p%t_1"), "path") == [("x/Report_1.txt",)]
    assert ca.search(files, "\\").collect() == []
    assert ca.statistics(files).first().asDict() == {"total_files": 3, "total_size": 42}
    assert ca.statistics(files.where("false")).first().asDict() == {"total_files": 0, "total_size": 0}


def test_content_search_ranks_name_path_text(spark, make):
    files = make(entry("1", "a/tax.txt", 1), entry("2", "tax/b.txt", 1), entry("3", "a/c.txt", 1), entry("4", "a/d.txt", 1))
    text = spark.createDataFrame(
        [("1", "x"), ("2", "TAX tax"), ("3", "tax"), ("4", "none")], "checksum string, text string"
    )
    found = ca.search_content(files.join(text, "checksum"), "tax").collect()
    assert [(r["checksum"], r["rank"], r["hits"]) for r in found] == [("1", 3, 0), ("2", 2, 2), ("3", 1, 1)]
    assert len(ca.search_content(files.join(text, "checksum"), "tax", limit=2).collect()) == 2


def test_export_and_delete(spark, make, tmp_path):
    files = make(entry("c1", "a", 2), entry("c1", "b", 1), entry("c2", "c", 1))
    wanted = spark.createDataFrame([("c1",), ("zz",), ("zz",)], "checksum string")
    out = str(tmp_path / "export")
    stored = spark.createDataFrame([(p, "text of " + p) for p in "abc"], "path string, text string")
    files = files.drop("checksum").join(
        stored.select(F.sha2("text", 256).alias("checksum"), F.col("path").alias("p")), F.col("p") == F.translate("path", "a", "b")
    ).drop("p")
    stored = stored.withColumn("text", F.when(F.col("path") == "a", "text of b").otherwise(F.col("text")))
    of = lambda text: __import__("hashlib").sha256(text.encode()).hexdigest()
    wanted = spark.createDataFrame([(of("text of b"),), ("zz",), ("zz",)], "checksum string")
    missing = ca.export(files, wanted, stored, out, content="text")
    assert keys(missing, "checksum") == [("zz",)]
    assert keys(spark.read.parquet(out), "checksum", "path", "content") == [(of("text of b"), "b", "text of b")]
    ids = files.where("path = 'a'").select("file_id").unionByName(
        spark.createDataFrame([("nope",)], "file_id string")
    )
    assert keys(ca.delete(files, ids), "path") == [("b",), ("c",)]
    assert keys(ca.unknown_ids(files, ids), "file_id") == [("nope",)]
    assert keys(ca.by_ids(files, ids), "path") == [("a",)]


def test_empty_queries_and_wildcards(spark, make):
    files = make(entry("1", "a/tax.txt", 1), entry("2", "b.txt", 2)).withColumn(
        "text", F.when(F.col("checksum") == "1", "foo bar foo1bar").otherwise("foo%bar")
    )
    found = ca.search_content(files, "").collect()
    assert [(r["checksum"], r["hits"]) for r in found] == [("2", 0), ("1", 0)]
    found = ca.search_content(files, "foo%bar").collect()
    assert [(r["checksum"], r["hits"]) for r in found] == [("1", 2), ("2", 1)]
    assert [r["hits"] for r in ca.search_content(files, "foo_bar").collect()] == [2, 1]


def test_search_filters_below_the_aggregate(spark, make):
    plan = ca.search(ca.distinct_files(make(entry("1", "a", 1))), "tax")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")


def test_a_batch_keeps_the_newest_row_per_key(make):
    rows = make(entry("c", "a", 1), entry("c", "a", 3), entry("c", "a", 2))
    assert [r["created_at"] for r in ca.distinct_files(rows).collect()] == [max(r["created_at"] for r in rows.collect())]


def test_requests_find_the_first_row_of_each_content(spark, make):
    files = make(*[entry(f"c{i % 50}", f"p{i}", 1000 - i) for i in range(500)])
    wanted = spark.createDataFrame([(f"c{i % 70}",) for i in range(300)], "checksum string")
    assert keys(ca.by_checksums(files, wanted), "checksum", "path") == sorted((f"c{i}", f"p{i + 450}") for i in range(50))


def test_written_catalog_reads_back_and_pushes_the_checksum_filter(spark, make, tmp_path):
    path = str(tmp_path / "catalog")
    ca.write_catalog(make(entry("c1", "a", 2), entry("c2", "b", 1)), path)
    found = spark.read.schema(CATALOG).parquet(path).where(F.col("checksum") == "c2")
    assert keys(found, "path") == [("b",)]
    assert "EqualTo(checksum,c2)" in found._jdf.queryExecution().executedPlan().toString()


def test_a_batch_rewrites_the_parts_it_touches(spark, tmp_path):
    import os

    from foliomine.functions import files as ff

    path = str(tmp_path / "catalog")

    def rows(n, batch, every=1):
        made = spark.range(0, n, every).select(
            ff.checksum(F.concat(F.lit("content "), F.col("id"))).alias("checksum"), F.lit("n").alias("name"), F.lit(3).alias("size"),
            F.concat(F.lit("p/"), F.col("id")).alias("path"), F.lit("t").alias("mime_type"), F.timestamp_seconds(F.lit(5)).alias("created_at"),
            F.lit(batch).alias("batch_no"),
        )
        return ca.catalog_rows(made)

    def files():
        return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if "=" in d}

    shown = lambda df: sorted(map(tuple, df.select("checksum", "path", "batch_no", "file_id").collect()))
    ca.write_parts(rows(2000, 0), path)
    before = files()
    assert len(before) == 256 and shown(ca.read_parts(spark, path)) == shown(rows(2000, 0))
    change = rows(2000, 1).where("checksum like 'a7%'").unionByName(rows(9000, 1).where("checksum like 'a7%' and path > 'p/8'"))
    expected = shown(ca.upsert(rows(2000, 0), change))
    for _ in range(2):
        ca.upsert_parts(spark, path, change)
        assert shown(ca.read_parts(spark, path)) == expected
    changed = {d for d, names in files().items() if names != before[d]}
    assert changed == {"part=a7"}

    before = files()
    gone = ca.read_parts(spark, path).where("part = '00' or part = 'ff' and path < 'p/15'").select("file_id")
    gone = spark.createDataFrame(gone.collect(), "file_id string")
    left = shown(ca.delete(ca.read_parts(spark, path), gone))
    for _ in range(2):
        ca.delete_parts(spark, path, gone)
        assert shown(ca.read_parts(spark, path)) == left and 0 < len(left) < len(expected)
    assert {d for d, names in files().items() if names != before[d]} == {"part=00", "part=ff"}
