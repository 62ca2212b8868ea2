"""The shape of the plans: what a cluster would run."""

import re

import pytest
from pyspark.sql import functions as F

from foliomine.operators import language as la, pairs as pa, records as rc, statements as st, templates as tp
from foliomine.plans import inputs
from foliomine.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(run(spark, SF)) for name, run in QUERIES.items()}


def test_no_python_no_cross_join(plans):
    for name, text in plans.items():
        for node in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in text, (name, node)


def test_only_totals_and_top_k_meet_in_one_partition(plans):
    single = {name for name, text in plans.items() if "SinglePartition" in text}
    assert single <= {"catalog_stats", "scan_ignore_counts", "catalog_content_top"}


def test_windows_only_rank_aggregated_rows(plans):
    """One window ranks counted trigrams, limited on both sides of its shuffle. The other
    one counts lines inside blocks of bounded size, and blocks by document."""
    with_window = {name for name, text in plans.items() if "Window [" in text}
    assert with_window == {"language_profiles", "language_id", "transactions_of_lines"}
    assert plans["language_profiles"].count("WindowGroupLimit") == 2


def test_document_operators_shuffle_nothing(spark, tmp_path):
    path = str(tmp_path / "docs")
    inputs.prose(spark, SF).write.parquet(path)
    docs = spark.read.parquet(path)
    page = inputs.with_layout(docs)
    zoned = tp.with_zones(tp.classify(page))
    files = page.select(
        "*", F.lit("p").alias("path"), F.sha2("text", 256).alias("checksum"), F.lit(None).cast("timestamp").alias("modified_at")
    )
    narrow = {
        "transactions": st.transactions(docs),
        "pairs": pa.pair_rows(docs, text="text"),
        "classify": tp.classify(page),
        "matches": tp.match_rows(zoned),
        "confidence": zoned.select(tp.confidence(F.col("zones"))),
        "fields": tp.field_rows(tp.classify(page).select("doc_id", "doc_type", tp.fields("page_text").alias("fields"))),
        "records": rc.assemble(rc.extract(files), F.lit(None).cast("timestamp"), "1"),
        "ranked": docs.select(la.ranked_trigrams(F.col("text"))),
    }
    for name, frame in narrow.items():
        text = plan(frame)
        assert "Exchange" not in text and "Window" not in text and "Join" not in text, name


def test_a_pattern_runs_once_per_group(spark, plans):
    """No optimizer rule has copied the zone expressions below a filter: 13 and
    12 patterns, once for the match and once per group, for two inputs, and the
    identifiers."""
    calls = sum(1 + re.compile(p).groups for t in tp.BUILTIN_TEMPLATES for z in t.zones for p in z.patterns)
    identifiers = sum(len(t.identifiers) for t in tp.BUILTIN_TEMPLATES)
    assert plans["zone_matches"].count("regexp_extract_all") <= 2 * (calls + identifiers)


def test_scans_read_only_what_they_need(plans):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plans["page_split"]
    assert "n_chars" not in plans["language_id"]
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plans["transactions"]


def test_one_shuffle_from_orders_to_transactions(plans):
    assert plans["transactions"].count("Exchange") == 1


def test_upserts_combine_before_the_shuffle(plans):
    for name in ("catalog_upsert", "catalog_latest", "catalog_export", "attr_update", "attr_insert"):
        assert "partial_max" in plans[name] or "partial_min" in plans[name], name


def test_hinted_broadcasts_are_those_with_a_checked_size(plans):
    """The language profile; every other broadcast is Spark's own choice by size."""
    import inspect

    from foliomine import operators
    import pathlib

    hinted = [
        p.name for p in pathlib.Path(inspect.getfile(operators)).parent.parent.rglob("*.py")
        if "F.broadcast(" in p.read_text() and p.parent.name != "llm"
    ]
    assert sorted(hinted) == ["language.py"]


def test_documents_of_one_row_group_are_rendered_in_many_tasks(spark):
    """A table in one file of one row group is read by one task; what is made of it is not."""
    for rows in (inputs.fee_statements(spark, SF), inputs.prose(spark, SF)):
        parts = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def _nodes(node):
    """The nodes of a plan that ran, those of its subqueries too; what is reused counts once."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return (yield from _nodes(node.executedPlan()))
    if kind.endswith("QueryStageExec"):
        return (yield from _nodes(node.plan()))
    yield node
    for below in (node.children(), node.subqueries()):
        for i in range(below.size()):
            yield from _nodes(below.apply(i))


def test_no_rows_of_words_are_shuffled(spark):
    """Pages move as text, by document; what is cut from them into words stays there."""

    def cuts(node):
        return any(n.nodeName() == "Generate" and "inline(words" in n.simpleString(200) for n in _nodes(node))

    for name in ("zone_text_from_words", "zone_text_joined"):
        frame = QUERIES[name](spark, SF)
        frame.collect()
        ran = frame._jdf.queryExecution().executedPlan()
        moved = [n for n in _nodes(ran) if n.getClass().getSimpleName() == "ShuffleExchangeExec"]
        assert cuts(ran) and moved and not any(cuts(n) for n in moved), name


def test_a_computed_index_is_computed_once(spark):
    """The count of the asked grams and their postings are of one pass over the texts."""
    for name in ("catalog_content_indexed", "catalog_content_indexed_top"):
        frame = QUERIES[name](spark, SF)
        frame.collect()
        ran = list(_nodes(frame._jdf.queryExecution().executedPlan()))
        made = [n for n in ran if n.nodeName() == "Generate" and "array_distinct" in n.simpleString(2000)]
        assert len(made) == 1, (name, len(made))


def test_documents_are_not_classified_where_they_are_read(plans):
    """No filter on the type, with all that makes it, stands below the shuffle of customers."""
    for name in ("zone_text_from_words", "zone_text_joined"):
        filters = [line for line in plans[name].splitlines() if re.search(r"[+:]- (\\*\(\d+\) )?Filter ", line)]
        assert filters and not any("greatest(struct(score" in line for line in filters), name


def test_records_move_texts_alone(spark, plans):
    """Each text moves by its id once, without what is made of it, and into a number of tasks
    that Spark doesn't lower by their bytes. Zone patterns are counted, not read by group."""
    frame = QUERIES["records"](spark, SF)
    frame.collect()
    moved = [n for n in _nodes(frame._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "ShuffleExchangeExec"]
    columns = [{n.output().apply(i).name() for i in range(n.output().size())} for n in moved]
    assert [c for c in columns if "text" in c] == [{"doc_id", "text"}]
    assert not any("page_text" in c or "checksum" in c for c in columns)
    assert plans["records"].count("regexp_extract_all") <= 54
