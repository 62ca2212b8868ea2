"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set. In a partition whose sets have
at most u shingles, an item's sketch is its bottom-k MinHash sketch with k one more
than what a contained item may miss: of k shingles of an item that a document contains
to the wanted share, one at least is in the document. The search therefore looks up
the documents' shingles in the sketches and misses no pair, however short the item and
long the document. Every candidate pair is then verified on the exact shingles, as
strings.

All steps are column expressions and joins. Generators are outer ones and no filter
stands on a computed array: Spark would push it below the projections and run the word
split once per shingle. The sketches are a fraction of the items;
Spark broadcasts them where its size check allows it and shuffles otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from foliomine.llm.scratch import materialise


def words_of(text: Column) -> Column:
    """Words of letters and digits, lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, n: int, combine) -> Column:
    """``combine`` of each run of n neighbours in an array; none in a shorter one."""
    count = F.size(words) - n + 1
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: combine(*(F.get(words, i + k) for k in range(n))))


def shingle_hashes(words: Column, n: int) -> Column:
    return F.array_distinct(_runs(words, n, F.xxhash64))


def shingles(words: Column, n: int) -> Column:
    return F.array_distinct(_runs(words, n, lambda *run: F.concat_ws(" ", *run)))


def _per_size(words: Column, n: int, make) -> Column:
    """Shingles of n words, or of all words where there are fewer."""
    size = F.size(words)
    column = F.when(size >= n, make(words, n))
    for shorter in range(1, n):
        column = column.when(size == shorter, make(words, shorter))
    return column


def sketches(items: DataFrame, n: int, percent: int) -> DataFrame:
    """``item_id, words_per_shingle, n_item, size_class, sketch`` of items with words."""
    rows = items.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    rows = rows.select(
        "item_id",
        F.least(F.size("words"), F.lit(n)).alias("words_per_shingle"),
        _per_size(F.col("words"), n, shingle_hashes).alias("hashes"),
    ).withColumn("n_item", F.size("hashes"))
    rows = rows.withColumn("size_class", F.floor(F.log2("n_item")).cast("int"))
    largest = F.pow(F.lit(2), F.col("size_class") + 1) - 1  # of the partition
    k = F.floor(largest * (100 - percent) / 100).cast("int") + 1
    return rows.withColumn("sketch", F.slice(F.array_sort("hashes"), F.lit(1), k)).drop("hashes")


def candidates(docs: DataFrame, items: DataFrame, n: int, percent: int) -> DataFrame:
    """Distinct ``doc_id, item_id, size`` with a sketch value of the item in the document;
    ``size`` is the number of words of the item's shingles."""
    found = sketches(items, n, percent).select(
        "item_id",
        "words_per_shingle",
        F.explode_outer("sketch").alias("hash"),
    )
    sizes = [r[0] for r in found.select("words_per_shingle").distinct().collect()]  # n at most
    words = docs.where("doc_id is not null").select("doc_id", words_of(F.col("text")).alias("words"))
    pairs = None
    for size in sorted(sizes):
        own = words.select("doc_id", shingle_hashes(F.col("words"), size).alias("hashes"))
        own = own.select("doc_id", F.explode_outer("hashes").alias("hash"))
        hits = own.join(found.where(F.col("words_per_shingle") == size), "hash")
        hits = hits.select("doc_id", "item_id", F.lit(size).alias("size"))
        pairs = hits if pairs is None else pairs.union(hits)
    if pairs is None:
        pairs = items.select(
            F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "item_id", F.lit(n).alias("size")
        ).limit(0)
    return pairs.distinct()


def _item_shingles(items: DataFrame, n: int) -> DataFrame:
    """``item_id, item_text, n_item, shingle``: the distinct shingles of each text of each
    item; ``item_text`` tells the texts of one id apart."""
    rows = items.select("item_id", F.xxhash64("text").alias("item_text"), words_of(F.col("text")).alias("words"))
    rows = rows.where("size(words) > 0").select(
        "item_id", "item_text", _per_size(F.col("words"), n, shingles).alias("shingles")
    )
    rows = rows.select(
        "item_id",
        "item_text",
        F.size("shingles").cast("long").alias("n_item"),
        F.explode_outer("shingles").alias("shingle"),
    )
    return rows.distinct()


def find_leaks(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, n_item, n_common``: the pairs in which the document holds at
    least ``percent`` per cent of the item's distinct shingles of ``n`` words.

    Uses ``doc_id`` and ``text`` of ``docs``, ``item_id`` and ``text`` of ``items``. An
    item of fewer words is one shingle of all its words. Documents and items without
    id, text or words are in no pair. Rows of one id count as one document or item;
    of different texts the larger share counts. Empty tables give an empty result.
    """
    items = items.where("item_id is not null").select("item_id", "text")
    pairs = materialise(candidates(docs, items, n, percent), "candidates")
    wanted = _item_shingles(items, n)
    sizes = [r[0] for r in pairs.select("size").distinct().collect()]  # n at most
    counts = pairs.select(
        "doc_id", F.lit(0).cast("long").alias("doc_text"), "item_id", F.lit(0).cast("long").alias("item_text"),
        *(F.lit(0).cast("long").alias(c) for c in ("n_item", "n_common")),
    ).limit(0)
    for size in sorted(sizes):
        of_size = pairs.where(F.col("size") == size).select("doc_id", "item_id")
        texts = docs.select("doc_id", "text").join(of_size.select("doc_id").distinct(), "doc_id", "left_semi")
        # Equal rows are one text.
        texts = texts.groupBy("doc_id", F.xxhash64("text").alias("doc_text")).agg(F.any_value("text").alias("text"))
        words = texts.select("doc_id", "doc_text", words_of(F.col("text")).alias("words"))
        own = words.select(
            "doc_id", "doc_text", F.explode_outer(shingles(F.col("words"), size)).alias("shingle")
        )
        common = own.join(of_size.join(wanted, "item_id"), ["doc_id", "shingle"])
        counts = counts.unionByName(
            common.groupBy("doc_id", "doc_text", "item_id", "item_text").agg(
                F.max("n_item").alias("n_item"), F.count("*").alias("n_common")
            )
        )
    share = F.max(F.struct(F.col("n_common") / F.col("n_item"), "n_common", "n_item"))
    best = counts.groupBy("doc_id", "item_id").agg(share.alias("best"))
    return best.select("doc_id", "item_id", "best.n_item", "best.n_common").where(
        F.col("n_common") * 100 >= F.col("n_item") * percent
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, whose document holds no item; rows without
    doc_id stay. See :func:`find_leaks`."""
    leaks = find_leaks(docs, items, n, percent).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)
