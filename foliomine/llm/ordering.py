"""Gapless numbers and running totals over the rows of a large table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from foliomine.llm.scratch import materialise

_IN_PARTITION = (1 << 33) - 1


def _ranges(df: DataFrame, order) -> DataFrame:
    """``df`` dealt out by ranges of the order, with each row's range and place in it."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = ranges.withColumns(
        {
            "_range": F.spark_partition_id(),
            "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)),
        }
    )
    return materialise(ranges, "ranges")


def _with_starts(ranges: DataFrame, total) -> DataFrame:
    """``ranges`` with the total of all ranges before in ``_start``."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("_range").agg(total.alias("n"))
    starts = starts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    # One row per range: as many as the exchange has partitions.
    return ranges.join(F.broadcast(starts), "_range")


def numbered(df: DataFrame, *order, column: str = "row_no") -> DataFrame:
    """``df`` with its rows numbered from 0 in the given order.

    The rows are dealt out by ranges of the order, so no key, however frequent, meets
    in one task as long as the order tells its rows apart. Each range is numbered on
    its own; the ranges' starts come from their counts, one row per range. Rows that
    are equal in the order get their numbers in any order.
    """
    rows = _with_starts(_ranges(df, order), F.count("*"))
    return rows.withColumn(column, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def running_total(df: DataFrame, value: str, *order, column: str = "before") -> DataFrame:
    """``df`` with the total of ``value`` over all rows before each row in the given
    order; dealt out as in :func:`numbered`."""
    rows = _with_starts(_ranges(df, order), F.sum(value))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return rows.withColumn(column, F.col("_start") + own).drop("_range", "_at", "_start")
