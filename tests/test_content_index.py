import pytest
from pyspark.sql import functions as F

from foliomine.operators import catalog as ca, content_index as ci

ROWS = [
    ("a/one.txt", "The License of 2024, straße, ΟΔΟΣ"),
    ("a/one.txt", "The License of 2024, straße, ΟΔΟΣ"),
    ("a/one.txt", "another content at the same path"),
    ("license/two.txt", "nothing here"),
    ("b/license.md", ""),
    ("b/three.txt", "lic\nense, 100% and LICENSE licenses"),
    ("b/four.txt", "li cen se"),
    ("b/null.txt", None),
    ("c/Überblick.txt", "x" * 100_000 + " the end 😀😀😀"),
]
QUERIES = ["license", "LICENSE", "li", "", "%", "100%", "lic%se", "l_cense", "the end", "😀😀😀", "ΟΔΟΣ", "Straße", "überBLICK", "zzz", "_x_", "a\\b"]


@pytest.fixture(scope="module")
def files(spark):
    rows = spark.createDataFrame(ROWS, "path string, text string")
    return rows.select(
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"),
        F.regexp_extract("path", "[^/]*$", 0).alias("name"),
        "path",
        F.timestamp_seconds(F.length("path")).alias("created_at"),
        "text",
    )


@pytest.fixture(scope="module")
def written(files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    ci.write_index(files, path)
    return path


@pytest.mark.parametrize("query", QUERIES)
def test_rows_are_those_of_the_scan(files, written, query):
    expected = list(map(tuple, ca.search_content(files, query).collect()))
    assert list(map(tuple, ci.search_written(files.limit(0), written, query).collect())) == expected
    top = ci.search_written(files.limit(0), written, query, limit=2).collect()
    assert list(map(tuple, top)) == expected[:2]


def test_only_the_parts_of_candidates_are_read(spark, files, written):
    """The rarest gram reaches the scan of the postings, the candidates' parts that of the
    texts; texts of other files are not read."""
    found = ci.search_written(files, written, "license")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "PartitionFilters" in plan
    assert "subquery" in plan.lower() and "NestedLoop" not in plan
    grams = ci.query_grams(spark, "license")
    index, counts = (spark.read.parquet(f"{written}/{name}") for name in ("postings", "grams"))
    held = {r["gram"]: r["n_files"] for r in counts.collect()}
    rare = ci.candidates(index, counts, ["lic", "the"]).count()
    assert rare == min(held["lic"], held["the"]) and set(grams) == {"lic", "ice", "cen", "ens", "nse"}
    assert ci.candidates(index, counts, ["lic", "qqq"]).count() == held["lic"]
    assert ci.candidates(index, counts, ["qqq"]).count() == 0


def test_postings_hold_each_gram_of_a_file_once(files):
    made = ci.postings(ci.with_ids(files))
    rows = [(r["gram"], r["file_id"]) for r in made.collect()]
    assert len(rows) == len(set(rows))
    assert {g for g, _ in rows} >= {"the", "😀😀😀", "übe", "100"}
    assert ci.postings(ci.with_ids(files.limit(0))).count() == 0


@pytest.mark.parametrize("query", QUERIES)
def test_a_computed_index_finds_what_the_scan_finds(files, query):
    made = ci.with_ids(files)
    index = ci.postings(made)
    expected = list(map(tuple, ca.search_content(files, query).collect()))
    assert list(map(tuple, ci.search(made, index, ci.gram_counts(index), query).collect())) == expected


def test_candidates_at_once_are_those_of_the_stored_index(spark, files, written):
    stored, counts = (spark.read.parquet(f"{written}/{name}") for name in ("postings", "grams"))
    index = ci.postings(ci.with_ids(files))
    for grams in (["lic", "the"], ["lic", "qqq"], ["qqq"], ["the", "😀😀😀", "ens"]):
        got = ci.candidates_at_once(index, ci.gram_counts(index), grams)
        expected = ci.candidates(stored, counts, grams)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())), grams
