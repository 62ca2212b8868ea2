import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from foliomine.functions import values as va
from foliomine.operators import attributes as at
from foliomine.schema import ATTRIBUTES
from foliomine.sources import attributes as src

COLUMNS = "scope string, key string, value string, default_value string, description string"


@pytest.fixture
def current(spark):
    return spark.createDataFrame(
        [("s", "a", "1", "0", "A"), ("s", "b", "[1, 2]", None, "B"), ("s", "c", "word", "w", "C")], COLUMNS
    )


@pytest.fixture
def batch(spark):
    def make(*rows):
        return spark.createDataFrame(
            [("s", k, i, v, d, "new") for i, (k, v, d) in enumerate(rows)],
            "scope string, key string, seq bigint, value string, default_value string, description string",
        )

    return make


def pairs(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def test_insert_is_strict_and_the_first_of_a_batch_wins(current, batch):
    table, rejected = at.insert(current, batch(("a", "9", None), ("x", "1", "d"), ("x", "2", None)))
    assert pairs(table, "key", "value", "default_value") == [
        ("a", "1", "0"), ("b", "[1, 2]", None), ("c", "word", "w"), ("x", "1", "d"),
    ]
    assert pairs(rejected, "key", "seq", "reason") == [("a", 0, "exists"), ("x", 2, "exists")]


def test_update_is_strict_and_the_last_change_wins(current, batch):
    table, rejected = at.update(current, batch(("a", "7", None), ("a", "8", None), ("y", "1", None)))
    assert pairs(table, "key", "value") == [("a", "8"), ("b", "[1, 2]"), ("c", "word")]
    assert pairs(rejected, "key", "reason") == [("y", "missing")]


def test_reset_needs_a_default(current, batch):
    changed, _ = at.update(current, batch(("a", "5", None), ("c", "z", None)))
    table, rejected = at.reset(changed, batch(("a", "", None), ("a", "", None), ("b", "", None), ("q", "", None)))
    assert pairs(table, "key", "value") == [("a", "0"), ("b", "[1, 2]"), ("c", "z")]
    assert pairs(rejected, "key") == [("b",), ("q",)]


def test_seed_and_create_or_update(spark, current, batch):
    defaults = spark.createDataFrame(
        [("s", "a", "9", "A"), ("s", "n", "3", "N")], "scope string, key string, value string, description string"
    )
    assert pairs(at.seed(current, defaults), "key", "value", "default_value") == [
        ("a", "1", "0"), ("b", "[1, 2]", None), ("c", "word", "w"), ("n", "3", "3"),
    ]
    table = at.create_or_update(current, batch(("a", "2", "zz"), ("k", "v", "d")))
    assert pairs(table, "key", "value", "default_value", "description") == [
        ("a", "2", "0", "A"), ("b", "[1, 2]", None, "B"), ("c", "word", "w", "C"), ("k", "v", "d", "new"),
    ]


def test_get_falls_back_to_the_callers_default(spark, current):
    requests = spark.createDataFrame(
        [("s", "b", None), ("s", "c", "x"), ("s", "m", "12"), ("s", "n", None)],
        "scope string, key string, default string",
    )
    found, rejected = at.get(current, requests)
    got = found.select("key", F.to_json("value").alias("json"))
    assert pairs(got, "key", "json") == [("b", "[1,2]"), ("c", '"word"'), ("m", '"12"')]
    assert pairs(rejected, "key", "reason") == [("n", "not found")]


def test_listing_parses_both_or_neither(spark):
    rows = spark.createDataFrame(
        [("s", "1", "5", None, ""), ("s", "2", "5", "word", ""), ("s", "3", "5", "true", ""),
         ("s", "4", "word", "6", ""), ("s", "5", "5", "", "")], COLUMNS,
    )
    got = at.listing(rows).select("key", F.to_json("value").alias("v"), F.to_json("default").alias("d"))
    assert pairs(got, "key", "v", "d") == [
        ("1", "5", None), ("2", '"5"', '"word"'), ("3", "5", "true"), ("4", '"word"', '"6"'), ("5", "5", None),
    ]


def test_encode_mask_validate(spark, current, batch):
    row = spark.range(1).select(
        va.encode(F.lit("x"), StringType()), va.encode(F.lit(3), IntegerType()),
        va.encode(F.array(F.lit(1), F.lit(2)), ArrayType(IntegerType())),
        va.mask(F.lit("sk-1234567890")), va.mask(F.lit("")),
    ).first()
    assert tuple(row) == ("x", "3", "[1,2]", "sk-12345...7890", "")
    changes = batch(("key", "sk-1", None), ("key", "org-1", None), ("key", "bad", None), ("other", "bad", None))
    ok, bad = at.validated_keys(changes, F.col("key") == "key")
    assert ok.count() == 3 and pairs(bad, "key", "reason") == [("key", "invalid format")]
    masked = at.masked(batch(("key", "sk-1234567890", None), ("o", "sk-1234567890", None)), F.col("key") == "key")
    assert pairs(masked, "value") == [("sk-12345...7890",), ("sk-1234567890",)]


def test_api_keys_without_value_are_rejected(batch):
    ok, bad = at.validated_keys(batch(("key", None, None), ("key", "sk-1", None)), F.col("key") == "key")
    assert pairs(ok, "value") == [("sk-1",)] and pairs(bad, "key") == [("key",)]


def test_export_and_import(spark, current, tmp_path):
    out = str(tmp_path / "out")
    at.export_json(current, out)
    lines = {r["key"]: json.loads(r["line"]) for r in spark.read.text(out).select(
        F.col("value").alias("line"), F.get_json_object("value", "$.key").alias("key")).collect()}
    assert lines["b"]["value"] == [1, 2] and lines["c"]["value"] == "word"
    assert sorted(src.read_attribute_lines(spark, out).collect()) == sorted(current.collect())
    document = {
        "test.key1": {"value": "value1", "default": "default1", "description": "Description 1"},
        "test.key2": {"value": [".txt", ".pdf"], "default": None, "description": ""},
        "test.key3": {"value": 104857600},
        "a": {"value": True, "default": False},
    }
    path = tmp_path / "in.json"
    path.write_text(json.dumps(document, indent=4))
    imported = src.read_attribute_json(spark, str(path), "s")
    assert pairs(imported, "key", "value", "default_value", "description") == [
        ("a", "true", "false", ""), ("test.key1", "value1", "default1", "Description 1"),
        ("test.key2", '[".txt",".pdf"]', None, ""), ("test.key3", "104857600", None, ""),
    ]
    table, rejected = at.insert(current, imported.withColumn("seq", F.lit(0)))
    assert table.count() == 6 and pairs(rejected, "key") == [("a",)]
    stored = str(tmp_path / "table")
    table.write.parquet(stored)
    assert src.read_attributes(spark, stored).schema == ATTRIBUTES


def test_a_key_without_value_exists(spark, current, batch):
    table = spark.createDataFrame([("s", "n", None, "d", "N")], COLUMNS)
    got = at.create_or_update(table, batch(("n", "5", "other"), ("m", "1", "x")))
    assert pairs(got, "key", "value", "default_value", "description") == [("m", "1", "x", "new"), ("n", "5", "d", "N")]


def test_values_of_any_type_are_stored_as_text(spark, current):
    rows = [("s", "a", 1, [1, 2], None, "new"), ("s", "q", 2, [], [3], "new")]
    typed = spark.createDataFrame(
        rows, "scope string, key string, seq bigint, value array<int>, default_value array<int>, description string"
    )
    assert pairs(at.update(current, typed)[0], "key", "value")[0] == ("a", "[1,2]")
    assert ("q", "[]", "[3]") in pairs(at.insert(current, typed)[0], "key", "value", "default_value")
    assert ("a", "[1,2]", "0") in pairs(at.create_or_update(current, typed), "key", "value", "default_value")
    numbers = typed.withColumn("value", F.col("seq") * 1.5).withColumn("default_value", F.lit(True))
    assert ("q", "3.0", "true") in pairs(at.insert(current, numbers)[0], "key", "value", "default_value")


def test_a_command_log_equals_its_commands_one_by_one(spark):
    import random

    rng = random.Random(7)
    start = {k: [rng.choice(["1", None]), rng.choice(["0", None]), k] for k in "abcde"}
    commands, state, rejected = [], {k: list(v) for k, v in start.items()}, []
    for seq in range(600):
        key, command = rng.choice("abcdefghijklmnop"), rng.choice(["insert", "update", "reset", "upsert"])
        value, default = rng.choice(["x", "y", "z", None]), rng.choice(["d", None])
        commands.append(("s", key, seq, command, value, default, f"by {seq}"))
        there, reason = state.get(key), None
        if command in ("insert", "upsert") and there is None:
            state[key] = [value, default, f"by {seq}"]
        elif command == "insert":
            reason = "exists"
        elif there is None:
            reason = "missing"
        elif command == "reset" and there[1] is None:
            reason = "no default"
        else:
            there[0] = there[1] if command == "reset" else value if value is not None else there[0]
        if reason:
            rejected.append((key, seq, command, reason))
    current = spark.createDataFrame([("s", k, *v) for k, v in start.items()], COLUMNS)
    rng.shuffle(commands)
    log = spark.createDataFrame(commands, "scope string, key string, seq bigint, command string, value string, default_value string, description string")
    table, refused = at.apply_commands(current, log)
    assert pairs(table, "key", "value", "default_value", "description") == sorted(((k, *v) for k, v in state.items()), key=repr)
    assert pairs(refused, "key", "seq", "command", "reason") == sorted(rejected, key=repr)
    table, refused = at.apply_commands(current, log.where("false"))
    assert table.count() == 5 and refused.count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_short_command_logs(spark, seed):
    """Logs of a few commands on one key, where the order matters most."""
    import itertools
    import random

    rng = random.Random(seed)
    commands, expected = [], []
    for key, kinds in enumerate(itertools.product(["insert", "update", "reset", "upsert"], repeat=3)):
        state = None
        for seq, command in enumerate(kinds):
            value, default = rng.choice(["x", "y", None]), rng.choice(["d", None])
            commands.append(("s", str(key), seq, command, value, default, "c"))
            if state is None:
                state = [value, default] if command in ("insert", "upsert") else None
            elif command == "reset":
                state[0] = state[0] if state[1] is None else state[1]
            elif command != "insert" and value is not None:
                state[0] = value
        if state:
            expected.append((str(key), *state))
    log = spark.createDataFrame(commands, "scope string, key string, seq bigint, command string, value string, default_value string, description string")
    table, _ = at.apply_commands(spark.createDataFrame([], COLUMNS), log)
    assert pairs(table, "key", "value", "default_value") == sorted(expected, key=repr)


def test_answers_to_a_batch_broadcast_no_copies(spark):
    """Requests meet no more copies of the table than they ask for, and neither side is held whole."""
    current = spark.range(5_000).selectExpr(
        "'s' as scope", "concat('k', id) as key", "'1' as value", "cast(null as string) as default_value", "'' as description"
    )
    asked = spark.range(900).selectExpr(
        "'s' as scope", "if(id % 3 = 0, 'k1', concat('k', id * 10)) as key", "id as seq", "cast(null as string) as default"
    )
    found, rejected = at.get(current, asked)
    inserted = at.insert(current, asked.selectExpr("scope", "key", "seq", "'2' as value", "default as default_value", "'' as description"))
    for answer in (found, rejected, inserted[1]):
        plan = answer._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode" not in plan and plan.count("SortMergeJoin") >= 2
    assert found.count() == 300 + 333 and rejected.count() == 267
    assert found.where("key = 'k1'").count() == 300 and inserted[1].count() == 900 - 267
