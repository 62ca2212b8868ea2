"""Category by a table of keywords, joined."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from foliomine.operators import needles

OTHER = "other"


def categorise(rows: DataFrame, keywords: DataFrame, description: str = "description") -> DataFrame:
    """``rows`` with ``category``: of ``keywords(category, priority, keyword)`` the category
    with the lowest priority, then the first by name, of which a keyword is inside the
    description; ``other`` where there is none.

    The same as :func:`foliomine.functions.categories.category` with the table's lists,
    for a table of any size. Null and empty keywords are left out. Of few keywords the best
    is found inside the row: no join, no shuffle, no copy of the row. Many keywords, or one of
    more than ``needles.MAX_LENGTH`` characters, are joined; then each distinct description
    is looked up once, so a frequent one is no hot key of the search.
    """
    line = F.lower(description)
    words = keywords.where(F.length("keyword") > 0).select("category", "priority", F.lower("keyword").alias("needle"))
    # Of the categories that share a keyword only the first can be a text's.
    words = words.groupBy("needle").agg(F.min(F.struct("priority", "category")).alias("_first"))
    few = words.select("needle", "_first.*").orderBy("priority", "category", "needle").limit(needles.FEW + 1).collect()
    if len(few) <= needles.FEW and all(len(r["needle"]) <= needles.MAX_LENGTH for r in few):
        ranked = needles.with_first(rows, line, [r["needle"] for r in few], "_first")
        names = F.from_json(F.lit(json.dumps([r["category"] for r in few])), "array<string>")
        category = F.coalesce(F.get(names, F.col("_first")), F.lit(OTHER)).alias("category")
        return ranked.select(*rows.columns, category)
    # A digest stands for a text where texts are not needed, so that joins move short keys.
    digest = lambda text: F.unhex(F.sha2(text, 256))
    distinct = rows.select(line.alias("text")).where(F.col("text").isNotNull()).distinct()
    texts = distinct.select(digest(F.col("text")).alias("text_id"), "text")
    searched = words.select("needle", F.array("needle").alias("pieces"))
    found = needles.candidates(texts, searched)
    best = (
        found.where(F.col("text").contains(F.col("needle")))
        .select("text_id", "needle")
        .join(words, "needle")
        .groupBy("text_id")
        .agg(F.min("_first").alias("_best"))
    )
    joined = rows.join(best, digest(F.lower(rows[description])) == best["text_id"], "left")
    return joined.select(
        *[rows[c] for c in rows.columns], F.coalesce(best["_best"]["category"], F.lit(OTHER)).alias("category")
    )
