import random

import pytest
from pyspark.sql import functions as F

from foliomine.operators import overlap as ov, templates as tp
from foliomine.plans import inputs
from foliomine.schema import WORD
from foliomine.sources import templates as tt

SF = "/root/testdata/sf0.001"
WORDS = "doc_id bigint, doc_type string, line_no int, word_no int, text string, x0 double, top double, x1 double, bottom double"
ZONES = "doc_type string, zone string, zone_no int, zone_x0 double, zone_top double, zone_x1 double, zone_bottom double"


def test_overlaps_against_all_pairs(spark):
    """Boxes on and beyond the page, turned round, without area, infinite, and incomplete."""
    rng = random.Random(5)
    value = lambda: rng.choice([rng.uniform(-0.5, 1.5), rng.randrange(9) / 8, float("inf"), float("-inf"), 1e12])
    words = [(i, rng.choice("ab"), i, 0, "w", *(value() for _ in range(4))) for i in range(300)]
    zones = [(t, f"z{i}", i, *(value() for _ in range(4))) for t in "ab" for i in range(40)]
    expected = sorted(
        (w[0], z[2])
        for w in words
        for z in zones
        if w[1] == z[0] and w[5] < z[5] and w[7] > z[3] and w[6] < z[6] and w[8] > z[4]
    )
    incomplete = [(900, "a", 0, 0, "w", None, 0.1, 0.9, 0.9), (901, None, 0, 0, "w", 0.1, 0.1, 0.9, 0.9)]
    got = ov.overlaps(
        spark.createDataFrame([*words, *incomplete], WORDS),
        spark.createDataFrame([*zones, ("a", "none", 99, None, 0.0, 1.0, 1.0)], ZONES),
    )
    assert sorted((r["doc_id"], r["zone_no"]) for r in got.collect()) == expected and len(expected) > 500


def test_zone_texts_equal_those_in_the_row(spark):
    documents = inputs.with_layout(inputs.rendered(spark, SF))
    typed = tp.classify(documents)
    words = tp.rows_of(documents, F.inline_outer("words"), "word_no").where("doc_id not like '%7'")
    left = typed.withColumn("words", F.when(F.expr("doc_id like '%7'"), F.array().cast(f"array<{WORD}>")).otherwise(F.col("words")))
    zones = ov.zone_boxes(tt.template_rows(spark, tt.BUILTIN_TEMPLATES))
    got = ov.zone_texts(typed.select("doc_id", "doc_type"), words, zones)
    expected = tp.zone_rows(tp.with_zones(left))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_thousands_of_zones_and_clashing_columns(spark):
    """A template of 2,500 small zones, nulls, repeated words, and columns of other use."""
    n = 50
    zones = [("t", f"z{i}", i, i % n / n, i // n / n, (i % n + 1) / n, (i // n + 1) / n) for i in range(n * n)]
    words = [
        (0, 1, 0, "a", 0.001, 0.001, 0.002, 0.002, "x"),
        (0, 1, 1, "b", 0.015, 0.001, 0.025, 0.002, "x"),  # over two zones
        (0, 1, 1, "b", 0.015, 0.001, 0.025, 0.002, "x"),
        (0, 2, 0, "c", 0.001, 0.003, 0.002, 0.004, None),
        (0, 3, 0, None, 0.001, 0.005, 0.002, 0.006, None),
        (None, 1, 0, "lost", 0.0, 0.0, 1.0, 1.0, None),
        (2, 1, 0, "untyped", 0.0, 0.0, 1.0, 1.0, None),
    ]
    made = spark.createDataFrame(
        words,
        "doc_id bigint, line_no int, word_no int, text string, x0 double, top double, x1 double, bottom double, cell_x string",
    ).withColumn("doc_type", F.lit("clash"))
    types = spark.createDataFrame([(0, "t"), (1, "t"), (2, None), (3, "unknown")], "doc_id bigint, doc_type string")
    rows = ov.zone_texts(types, made, spark.createDataFrame(zones, ZONES)).collect()
    got = {(r["doc_id"], r["zone_no"]): r["text"] for r in rows}
    assert len(rows) == len(got) == 2 * n * n
    assert {k: t for k, t in got.items() if t} == {(0, 0): "a b b\nc", (0, 1): "b b"}
    none = made.limit(0)
    assert {r["text"] for r in ov.zone_texts(types, none, spark.createDataFrame(zones[:3], ZONES)).collect()} == {""}
