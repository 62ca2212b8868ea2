"""Category keywords from a table."""

from pyspark.sql import DataFrame


MAX_KEYWORDS = 2000


def keywords_from(table: DataFrame, max_keywords: int = MAX_KEYWORDS) -> list[tuple[str, list[str]]]:
    """``table(category, priority, keyword)`` as keyword lists for
    :func:`foliomine.functions.categories.category`: a list per priority and category,
    in the order they are tried; empty keywords are left out. The keywords become one
    expression of the plan, so a table beyond ``max_keywords`` is refused: for it there is
    :func:`foliomine.operators.categories.categorise`, which joins it."""
    lists: list[tuple[str, list[str]]] = []
    last = None
    rows = table.where("length(keyword) > 0").orderBy("priority", "category", "keyword").limit(max_keywords + 1).collect()
    if len(rows) > max_keywords:
        raise ValueError(f"more than {max_keywords} keywords")
    for row in rows:
        if last != (row["priority"], row["category"]):
            last = row["priority"], row["category"]
            lists.append((row["category"], []))
        lists[-1][1].append(row["keyword"].lower())
    return lists
