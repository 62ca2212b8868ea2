"""Sharding by balanced label propagation.

Documents of equal text are linked, each to the group's hub, so a group of n has n
links and not n * (n - 1) / 2. Every document starts in a shard by its hash. In each
round the parts of a group vote by size; a part moves towards the shard that holds
most of its group as far as that shard has room under its quota of rows. Unlinked
documents fill the rest, so that in the end the shards' counts differ by one at most.

A part is all documents of a group that started in the same shard: a group has no
more parts than there are shards, however many documents it has, and rounds handle
parts only. What comes to the driver is a row per shard.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliomine.llm.ordering import numbered
from foliomine.llm.scratch import materialise

ROUNDS = 12
SLICES = 1024  # of a shard's applicants, which are let in slice by slice


def _lookup(values: list[int], index: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), index)


def quotas(n_rows: int, n_shards: int) -> list[int]:
    """Rows per shard; the first ones take one more where the division leaves a rest."""
    return [n_rows // n_shards + (j < n_rows % n_shards) for j in range(n_shards)]


def _per_shard(rows: DataFrame, value: Column, n_shards: int) -> list[int]:
    found = rows.groupBy("shard").agg(value.alias("n")).collect()  # a row per shard
    counts = [0] * n_shards
    for row in found:
        counts[row["shard"]] = row["n"]
    return counts


def _is_own(vote: Column) -> Column:
    return vote["shard"] == F.col("shard")


def _draws(vote: Column, room: list[int]) -> Column:
    return (vote > F.col("own")) & (_lookup(room, vote["shard"]) >= F.col("n"))


def propagate(parts: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``parts(group, home, shard, n)`` after their moves; ``n`` counts documents."""
    parts = materialise(parts, "parts")
    for number in range(rounds):
        loads = _per_shard(parts, F.sum("n"), len(quota))
        room = [max(0, q - load) for q, load in zip(quota, loads)]
        votes = parts.groupBy("group", "shard").agg(F.sum("n").alias("held"))
        weight = F.struct("held", F.xxhash64("group", "shard").alias("tie"), "shard")
        votes = votes.groupBy("group").agg(F.collect_list(weight).alias("votes"))  # one per shard
        # A shard without room for a part draws it not, but keeps those it holds.
        moves = parts.join(votes, "group").withColumn("own", F.filter("votes", _is_own)[0])
        drawing = F.filter("votes", lambda v: _draws(v, room))
        moves = moves.select(
            "group",
            "home",
            "shard",
            "n",
            F.pmod(F.xxhash64("group", "home", F.lit(number)), F.lit(SLICES)).alias("slice"),
            F.array_max(drawing)["shard"].alias("wanted"),
        )
        moves = materialise(moves, "moves")
        so_far = Window.partitionBy("wanted").orderBy("slice")
        let_in = (
            moves.where("wanted is not null")
            .groupBy("wanted", "slice")
            .agg(F.sum("n").alias("n"))
            .withColumn("total", F.sum("n").over(so_far))  # SLICES rows per shard
            .where(F.col("total") <= _lookup(room, F.col("wanted")))
            .groupBy("wanted")
            .agg(F.max("slice").alias("last"))
            .collect()
        )
        if not let_in:
            break
        last = [-1] * len(quota)
        for row in let_in:
            last[row["wanted"]] = row["last"]
        moved = F.col("wanted").isNotNull() & (F.col("slice") <= _lookup(last, F.col("wanted")))
        parts = moves.select(
            "group", "home", F.when(moved, F.col("wanted")).otherwise(F.col("shard")).alias("shard"), "n"
        )
    return parts


def shard_documents(docs: DataFrame, n_shards: int = 40, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, a row per row of
    ``docs``; the law is ``rows``: counts of shards are at most one apart.

    Uses ``doc_id`` and ``text``. ``size`` is the text's UTF-8 bytes plus 16; a null
    text has no bytes, the crc32 of none, and no links, while empty texts are equal
    texts. Slots of a shard start at 0 without gaps, its linked documents first.
    Repeated rows each get a slot of their own; a null doc_id is a value like any
    other. An empty table gives an empty result. ``grown_shard`` is null.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.md5("text")).alias("group"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    home = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_shards)).cast("int")
    rows = materialise(rows.withColumn("home", home), "rows")
    quota = quotas(rows.count(), n_shards)

    by_home = rows.where("group is not null").groupBy("group", "home").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("group"))  # n_shards rows at most
    parts = by_home.withColumn("whole", whole).where("whole > 1")
    parts = propagate(parts.select("group", "home", F.col("home").alias("shard"), "n"), quota, rounds)

    placed = rows.join(parts.select("group", "home", "shard"), ["group", "home"], "left").select(
        "doc_id", "size", "text_crc32", "row_id",
        F.coalesce("shard", "home").alias("shard"),
        F.when(F.col("shard").isNull(), F.xxhash64("doc_id", "row_id")).alias("filler"),
        F.when(F.col("shard").isNotNull(), F.col("group")).alias("group"),
    )
    # Nulls first: linked documents, group by group, then unlinked ones.
    placed = numbered(placed, "shard", "filler", "group", "doc_id", "row_id")

    counts = _per_shard(placed, F.count("*"), n_shards)
    start = [0, *accumulate(counts)]
    over = [max(0, c - q) for c, q in zip(counts, quota)]
    under = [max(0, q - c) for c, q in zip(counts, quota)]
    over_start, under_end = [0, *accumulate(over)], list(accumulate(under))
    shard = F.col("shard")
    ends = F.array(*(F.lit(v).cast("long") for v in under_end))
    placed = placed.withColumn("rank", F.col("row_no") - _lookup(start, shard))
    placed = placed.withColumn("spill", _lookup(over_start, shard) + F.col("rank") - _lookup(quota, shard))
    placed = placed.withColumn("refuge", F.size(F.filter(ends, lambda end: end <= F.col("spill"))))
    stays, refuge = F.col("rank") < _lookup(quota, shard), F.col("refuge")
    spilled_slot = _lookup(counts, refuge) + F.col("spill") - _lookup([0, *under_end], refuge)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(stays, shard).otherwise(refuge).cast("int").alias("shard"),
        F.when(stays, F.col("rank")).otherwise(spilled_slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
