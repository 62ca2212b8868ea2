"""Attributes: keyed values with defaults, ``(scope, key)`` unique.

Changes arrive as batches. A batch may name one key any number of times, so it
is first reduced to one row per key by an aggregate before it is joined. Where every
row of a batch needs an answer, the batch is salted and the unique side copied per
salt asked for, so a key that holds a third of all rows is spread over ``SALTS`` tasks.
No side is broadcast by hint; Spark does so where its size allows, but for the salted joins.
"""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from foliomine.functions import values
from foliomine.schema import ATTRIBUTE_KEY, ATTRIBUTES

_COLUMNS = ATTRIBUTES.fieldNames()
SALTS = 16


def _join_salted(rows: DataFrame, unique: DataFrame) -> DataFrame:
    """Left join of a batch with one row per key.

    A key is copied for those salts alone under which the batch asks for it, so there are
    never more copies than rows of the batch. Spark estimates neither side well: one is an
    aggregate of a compressed file, the other is copied. So both joins are sort-merge joins,
    which hold no side whole."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    asked = salted.select(*ATTRIBUTE_KEY, "_salt").distinct()
    copies = asked.join(unique.hint("merge"), ATTRIBUTE_KEY)
    return salted.join(copies.hint("merge"), [*ATTRIBUTE_KEY, "_salt"], "left").drop("_salt")


def _one_per_key(changes: DataFrame, pick) -> DataFrame:
    """Row of each key that ``pick`` (F.min or F.max) finds by ``seq``."""
    rest = [c for c in changes.columns if c not in (*ATTRIBUTE_KEY, "seq")]
    return (
        changes.groupBy(*ATTRIBUTE_KEY)
        .agg(pick(F.struct("seq", *rest)).alias("row"))
        .select(*ATTRIBUTE_KEY, "row.seq", *[f"row.{c}" for c in rest])
    )


def first_per_key(changes: DataFrame) -> DataFrame:
    return _one_per_key(changes, F.min)


def last_per_key(changes: DataFrame) -> DataFrame:
    return _one_per_key(changes, F.max)


def encoded(changes: DataFrame) -> DataFrame:
    """``changes`` with ``value`` and ``default_value`` of any type as they are stored:
    strings stay, arrays, maps and structs become JSON, other values their text."""
    typed = [f for f in changes.schema if f.name in ("value", "default_value") and f.dataType != StringType()]
    return changes.withColumns({f.name: values.encode(F.col(f.name), f.dataType) for f in typed})


def insert(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add new keys. Returns the new table and ``rejected(scope, key, seq,
    reason)``: keys that exist, or came earlier in the batch.

    ``incoming`` is an attribute table with a ``seq`` that orders the batch; its values may
    be of any type.
    """
    incoming = encoded(incoming)
    first = first_per_key(incoming)
    new = first.join(current, ATTRIBUTE_KEY, "left_anti")
    accepted = new.select(*ATTRIBUTE_KEY, F.col("seq").alias("_accepted"))
    rejected = (
        _join_salted(incoming.select(*ATTRIBUTE_KEY, "seq"), accepted)
        .where(~F.col("seq").eqNullSafe(F.col("_accepted")))
        .select(*ATTRIBUTE_KEY, "seq", F.lit("exists").alias("reason"))
    )
    return current.select(*_COLUMNS).unionByName(new.select(*_COLUMNS)), rejected


def update(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set values of existing keys; the last change of a key wins. Returns the
    new table and ``rejected(scope, key, reason)``. Values may be of any type."""
    last = last_per_key(encoded(changes)).select(*ATTRIBUTE_KEY, F.col("value").alias("_new"))
    updated = current.join(last, ATTRIBUTE_KEY, "left").select(
        *ATTRIBUTE_KEY,
        F.coalesce("_new", "value").alias("value"),
        "default_value",
        "description",
    )
    return updated, _rejected(last, current, "missing")


def _rejected(asked: DataFrame, present: DataFrame, reason: str) -> DataFrame:
    return asked.join(present, ATTRIBUTE_KEY, "left_anti").select(
        *ATTRIBUTE_KEY, F.lit(reason).alias("reason")
    )


def reset(current: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put keys back to their default. Keys that are missing or have none are rejected."""
    asked = keys.select(*ATTRIBUTE_KEY).distinct()
    hit = F.col("_hit") & F.col("default_value").isNotNull()
    updated = current.join(asked.withColumn("_hit", F.lit(True)), ATTRIBUTE_KEY, "left").select(
        *ATTRIBUTE_KEY,
        F.when(hit, F.col("default_value")).otherwise(F.col("value")).alias("value"),
        "default_value",
        "description",
    )
    with_default = current.where(F.col("default_value").isNotNull())
    return updated, _rejected(asked, with_default, "missing or no default")


def seed(current: DataFrame, defaults: DataFrame) -> DataFrame:
    """Add the default keys that are absent: ``defaults(scope, key, value,
    description)``, one row per key."""
    absent = defaults.join(current, ATTRIBUTE_KEY, "left_anti")
    return current.select(*_COLUMNS).unionByName(
        absent.withColumn("default_value", F.col("value")).select(*_COLUMNS)
    )


def create_or_update(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the value where the key exists, add the key where it does not. A key whose value
    is NULL exists. Values may be of any type."""
    last = last_per_key(encoded(changes)).select(
        *ATTRIBUTE_KEY,
        F.col("value").alias("_value"),
        F.col("default_value").alias("_default"),
        F.col("description").alias("_description"),
    )
    exists = F.col("_exists").isNotNull()
    return current.withColumn("_exists", F.lit(True)).join(last, ATTRIBUTE_KEY, "full").select(
        *ATTRIBUTE_KEY,
        F.coalesce("_value", "value").alias("value"),
        F.when(exists, F.col("default_value")).otherwise(F.col("_default")).alias("default_value"),
        F.when(exists, F.col("description")).otherwise(F.col("_description")).alias("description"),
    )


# Commands of a log, in the column ``command``.
INSERT, UPDATE, RESET, UPSERT = "insert", "update", "reset", "upsert"


def apply_commands(current: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply a log of mixed commands as if one by one in the order of ``seq``.

    ``commands(scope, key, seq, command, value, default_value, description)``; ``seq`` is
    unique per key, values may be of any type. An insert adds a key that is absent, an update sets the value of one
    that exists, a reset puts back a default that is not NULL, an upsert sets or adds; a
    NULL value changes nothing. Returns the new table and ``rejected(scope, key, seq,
    command, reason)`` with the reasons ``exists``, ``missing`` and ``no default``.

    A key that exists stays, with its default and description. So its state after any
    number of commands follows from the one that made it, the last that set a value
    behind that one and the last reset: three aggregates per key, combined before the
    shuffle, so that a key with any share of the log is one row per task.
    """
    commands = encoded(commands)
    makes = F.col("command").isin(INSERT, UPSERT)
    sets = F.col("command").isin(UPDATE, UPSERT) & F.col("value").isNotNull()
    per_key = commands.groupBy(*ATTRIBUTE_KEY).agg(
        F.min(F.when(makes, F.struct("seq", "value", "default_value", "description"))).alias("_made"),
        F.max(F.when(sets, F.struct("seq", "value"))).alias("_set"),
        F.max(F.when(F.col("command") == RESET, F.col("seq"))).alias("_reset"),
    )
    present = current.select(*_COLUMNS, F.lit(True).alias("_present"))
    joined = present.join(per_key, ATTRIBUTE_KEY, "full").withColumn(
        "_present", F.coalesce("_present", F.lit(False))
    )
    # What was asked before the key was there did nothing.
    counts = lambda seq: F.coalesce(F.col("_present") | (seq > F.col("_made.seq")), F.lit(False))
    kept = lambda name: F.when(F.col("_present"), F.col(name)).otherwise(F.col(f"_made.{name}"))
    state = joined.select(
        *ATTRIBUTE_KEY,
        "_present",
        F.when(~F.col("_present"), F.col("_made.seq")).alias("_made_at"),
        (F.col("_present") | F.col("_made").isNotNull()).alias("_exists"),
        kept("value").alias("value"),
        kept("default_value").alias("default_value"),
        kept("description").alias("description"),
        F.when(counts(F.col("_set.seq")), F.col("_set")).alias("_set"),
        F.when(counts(F.col("_reset")), F.col("_reset")).alias("_reset"),
    )
    put_back = F.col("default_value").isNotNull() & F.coalesce(
        F.col("_reset") > F.coalesce(F.col("_set.seq"), F.col("_reset") - 1), F.lit(False)
    )
    table = state.where("_exists").select(
        *ATTRIBUTE_KEY,
        F.when(put_back, F.col("default_value")).otherwise(F.coalesce("_set.value", "value")).alias("value"),
        "default_value",
        "description",
    )
    facts = state.select(
        *ATTRIBUTE_KEY, "_present", "_made_at", F.col("default_value").isNotNull().alias("_has_default")
    )
    answered = _join_salted(commands.select(*ATTRIBUTE_KEY, "seq", "command"), facts)
    there = F.col("_present") | F.coalesce(F.col("seq") > F.col("_made_at"), F.lit(False))
    reason = (
        F.when((F.col("command") == INSERT) & there, "exists")
        .when(F.col("command").isin(UPDATE, RESET) & ~there, "missing")
        .when((F.col("command") == RESET) & ~F.col("_has_default"), "no default")
    )
    rejected = answered.select(*ATTRIBUTE_KEY, "seq", "command", reason.alias("reason"))
    return table, rejected.where(F.col("reason").isNotNull())


def get(current: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answer ``requests(scope, key, default)``: the stored value, else the
    caller's default. Returns answers with ``raw`` and its decoded ``value``,
    and the requests that have neither."""
    stored = current.select(*ATTRIBUTE_KEY, F.col("value").alias("_stored"))
    answered = _join_salted(requests, stored).withColumn("raw", F.coalesce("_stored", "default"))
    found = answered.where(F.col("raw").isNotNull()).select(
        *requests.columns,
        "raw",
        F.when(F.col("_stored").isNotNull(), values.decode(F.col("_stored")))
        .otherwise(F.col("default").cast("variant"))
        .alias("value"),
    )
    rejected = answered.where(F.col("raw").isNull()).select(
        *ATTRIBUTE_KEY, F.lit("not found").alias("reason")
    )
    return found, rejected


def listing(current: DataFrame) -> DataFrame:
    """All attributes with value and default decoded together."""
    value, default = values.decode_pair(F.col("value"), F.col("default_value"))
    return current.select(
        *ATTRIBUTE_KEY, value.alias("value"), default.alias("default"), "description"
    )


def masked(current: DataFrame, is_secret: Column) -> DataFrame:
    return current.withColumn(
        "value", F.when(is_secret, values.mask(F.col("value"))).otherwise(F.col("value"))
    )


def validated_keys(changes: DataFrame, is_api_key: Column) -> tuple[DataFrame, DataFrame]:
    """Split changes into those to store and API keys of a wrong form, NULL included."""
    wrong = F.coalesce(is_api_key, F.lit(False)) & ~F.coalesce(
        values.is_api_key(F.col("value")), F.lit(False)
    )
    rejected = changes.where(wrong).select(*ATTRIBUTE_KEY, F.lit("invalid format").alias("reason"))
    return changes.where(~wrong), rejected


def export_json(current: DataFrame, path: str) -> None:
    """One JSON object per line: scope, key, decoded value and default, description, and
    the stored texts, from which
    :func:`foliomine.sources.attributes.read_attribute_lines` reads the same table back."""
    value, default = values.decode_pair(F.col("value"), F.col("default_value"))
    rows = current.select(
        *ATTRIBUTE_KEY,
        value.alias("value"),
        default.alias("default"),
        "description",
        F.col("value").alias("stored"),
        F.col("default_value").alias("stored_default"),
    )
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
