"""Raw table cells to tables with headers."""

from pyspark.sql import Column, DataFrame, functions as F

from foliomine.schema import TABLE


def normalise(tables: Column) -> Column:
    """Drop tables without any filled cell; row one becomes the headers."""
    filled = F.filter(
        tables,
        lambda t: F.exists(t, lambda row: F.exists(row, lambda cell: F.coalesce(cell, F.lit("")) != "")),
    )
    return F.transform(
        filled,
        lambda t: F.struct(
            F.get(t, F.lit(0)).alias("headers"),
            F.slice(t, F.lit(2), F.size(t)).alias("data"),
        ),
    ).cast(f"array<{TABLE}>")


def of_documents(pages: DataFrame) -> DataFrame:
    """``(doc_id, tables)`` from ``pages(doc_id, page_no, tables)``: the tables of
    all pages, in page order. The result is one value per document, so a
    document's tables have to fit one row; :func:`table_rows` has no such bound."""
    by_page = F.array_sort(
        F.collect_list(F.struct("page_no", normalise(F.col("tables")).alias("tables")))
    )
    return pages.groupBy("doc_id").agg(
        F.flatten(F.transform(by_page, lambda p: p["tables"])).alias("tables")
    )


def table_rows(pages: DataFrame) -> DataFrame:
    """``(doc_id, page_no, table_no, row_no, headers, cells)``, one row per data
    row of every table; a table of headers alone is one row without row number and
    cells. Nothing is gathered, so nothing is shuffled."""
    tables = pages.select(
        "doc_id", "page_no", F.posexplode(normalise(F.col("tables"))).alias("table_no", "t")
    )
    return tables.select(
        "doc_id",
        "page_no",
        "table_no",
        F.posexplode_outer("t.data").alias("row_no", "cells"),
        F.col("t.headers").alias("headers"),
    )
