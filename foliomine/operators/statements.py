"""Transactions and balances of bank statements."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliomine.functions import categories
from foliomine.functions.text import (
    checked_date,
    first_match,
    german_amount_or_null,
    german_cents,
    pattern,
    strip,
)
from foliomine.schema import TRANSACTION

# The dated line that opens a transaction, and what may follow it.
DATED_LINE = r"(\d{2}\.\d{2}\.\d{4})\s+([^-\d].*?)(?:\s+|$)([-\d.,]+)?\s*$"
_DATED_HEAD = pattern(rf"(?s:^.*?){DATED_LINE}")
_SET_APART = "\x01"
MANDATE = r"Mandat:([^\n]+)"
REFERENCE = r"Referenz:([^\n]+)"
BLOCK_LINES = 100_000  # lines of a statement that one task numbers
NO_DESCRIPTION = ["buchung", "valuta"]
BALANCES = {
    "opening_balance": r"Alter\s+Saldo\s+([\d.,]+)\s*Euro",
    "closing_balance": r"Neuer\s+Saldo\s+([\d.,]+)\s*Euro",
    "overdraft_limit": r"Eingeräumte\s+Kontoüberziehung\s+([\d.,]+)\s*Euro",
}


def transaction_blocks(text: Column) -> Column:
    """``array<array<string>>``: each dated line with the lines up to the next one.

    Lines before the first dated line belong to no block. All lines of a
    document are in its row, so cutting them there needs no shuffle, no window
    and no order column, but one task does it; :func:`transactions_of_lines` spreads a
    statement that is too long for that.
    """
    dated = pattern(DATED_LINE)

    def starts(lines: Column) -> Column:
        marked = F.transform(lines, lambda line, i: F.when(line.rlike(dated), i + 1))
        return F.filter(marked, lambda i: i.isNotNull())

    def cut(doc: Column) -> Column:
        lines, first = doc["lines"], doc["starts"]
        end = lambda k: F.coalesce(F.get(first, k + 1), F.size(lines) + 1)
        return F.transform(first, lambda s, k: F.slice(lines, s, end(k) - s))

    lines = F.transform(
        F.array(F.split(text, "\n")),
        lambda l: F.struct(l.alias("lines"), starts(l).alias("starts")),
    )
    return F.get(F.transform(lines, cut), F.lit(0))


def _holds(line: Column, regex: str) -> Column:
    """Whether a line matches; its text up to the colon is sought first, as few lines have it."""
    return line.contains(regex.partition(":")[0] + ":") & line.rlike(pattern(regex))


def _last_value(lines: Column, regex: str) -> Column:
    """Group of the last line that matches, '' when none does."""
    hits = F.filter(lines, lambda line: _holds(line, regex))
    last = F.try_element_at(hits, F.lit(-1))
    return F.coalesce(strip(F.regexp_extract(last, pattern(regex), 1)), F.lit(""))


Fields = Callable[[str], Column]


def _split_block(block: Column) -> dict[str, Column]:
    """The head is its date, label and amount set apart by a sign, so that it is matched once."""
    return {
        "head": F.regexp_replace(F.get(block, F.lit(0)), _DATED_HEAD, f"$1{_SET_APART}$2{_SET_APART}$3"),
        "rest": F.slice(block, F.lit(2), F.size(block)),
    }


def _read_head(of: Fields) -> dict[str, Column]:
    # A date has ten characters and an amount never has the sign; a label may.
    amount = F.substring_index(of("head"), _SET_APART, -1)
    return {
        "rest": of("rest"),
        "date_value": checked_date(F.substr(of("head"), F.lit(1), F.lit(10))),
        "label": F.substr(of("head"), F.lit(12), F.length(of("head")) - F.length(amount) - 12),
        "amount_text": F.nullif(amount, F.lit("")),
    }


def _well_formed(of: Fields) -> Column:
    amount = german_amount_or_null(of("amount_text"))
    return of("date_value").isNotNull() & (of("amount_text").isNull() | amount.isNotNull())


def _transaction(of: Fields) -> dict[str, Column]:
    def describes(line: Column) -> Column:
        hidden = F.lower(line).rlike("|".join(NO_DESCRIPTION))
        return ~_holds(line, REFERENCE) & ~hidden

    more = F.transform(F.filter(of("rest"), describes), strip)
    return {
        "date": F.date_format(of("date_value"), "yyyy-MM-dd"),
        "description": F.array_join(F.concat(F.array(strip(of("label"))), more), " "),
        "amount": german_amount_or_null(of("amount_text")),
        "category": categories.category(of("label")),
        "reference": _last_value(of("rest"), REFERENCE),
        "mandate": _last_value(of("rest"), MANDATE),
    }


def transactions(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per transaction: ``(doc_id, txn_no, date, date_value, description,
    amount, amount_cents, category, reference, mandate)``.

    A dated line whose date or amount does not parse opens a block of its own,
    which is left out with the lines that follow it.
    """
    blocks = documents.select(
        "doc_id", F.posexplode(transaction_blocks(F.col(text))).alias("n", "block")
    )
    return _of_blocks(blocks.select("doc_id", (F.col("n") + 1).alias("txn_no"), "block"))


def _of_blocks(blocks: DataFrame) -> DataFrame:
    """The transactions of ``blocks(doc_id, txn_no, block)``."""

    def columns(fields: dict[str, Column]) -> list[Column]:
        return [column.alias(name) for name, column in fields.items()]

    split = blocks.select("doc_id", "txn_no", *columns(_split_block(F.col("block"))))
    read = split.select("doc_id", "txn_no", *columns(_read_head(F.col)))
    return read.where(_well_formed(F.col)).select(
        "doc_id",
        "txn_no",
        "date_value",
        german_cents(F.col("amount_text")).alias("amount_cents"),
        *columns(_transaction(F.col)),
    )


def line_rows(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, line_no, line)`` of each document's lines, numbered from 1."""
    lines = documents.select("doc_id", F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


def with_transaction_no(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """``lines(doc_id, line_no, line)`` with ``txn_no``, the number of dated lines in their
    document up to them; 0 for lines before the first one.

    A prefix sum in two levels. A document's lines are dealt out in blocks of
    ``block_lines`` line numbers and summed up there; the blocks' totals, a row per block,
    are summed up by document, and each block starts from the total of those before it.
    No task holds more than one block of lines at a time, however long a statement is.
    """
    block = F.floor(F.col("line_no") / block_lines).alias("block")
    dated = F.when(F.col("line").rlike(pattern(DATED_LINE)), 1).otherwise(0).alias("dated")
    marked = lines.select("doc_id", "line_no", "line", block, dated)
    totals = marked.groupBy("doc_id", "block").agg(F.sum("dated").alias("n"))
    earlier = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("doc_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carry"))
    inside = Window.partitionBy("doc_id", "block").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counted = marked.withColumn("n", F.sum("dated").over(inside))
    return counted.join(carried, ["doc_id", "block"]).select(
        "doc_id", "line_no", "line", (F.col("carry") + F.col("n")).cast("int").alias("txn_no")
    )


def transactions_of_lines(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """As :func:`transactions`, from ``lines(doc_id, line_no, line)``.

    Line numbers are unique in their document and give its order; they may have gaps.
    The lines of one transaction meet in one row.
    """
    numbered = with_transaction_no(lines, block_lines).where("txn_no > 0")
    gathered = numbered.groupBy("doc_id", "txn_no").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines")
    )
    blocks = gathered.select("doc_id", "txn_no", F.transform("lines", lambda l: l["line"]).alias("block"))
    return _of_blocks(blocks)


def transaction_array(text: Column) -> Column:
    """The transactions of one document as an array, for its record."""

    def struct(fields: dict[str, Column]) -> Column:
        return F.struct(*[column.alias(name) for name, column in fields.items()])

    split = F.transform(transaction_blocks(text), lambda b: struct(_split_block(b)))
    read = F.transform(split, lambda s: struct(_read_head(lambda n: s[n])))
    kept = F.filter(read, lambda s: _well_formed(lambda n: s[n]))
    return F.transform(kept, lambda s: struct(_transaction(lambda n: s[n]))).cast(
        f"array<{TRANSACTION}>"
    )


def malformed_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, line)``: dated lines that :func:`transactions` leaves out."""
    dated = pattern(DATED_LINE)
    lines = documents.select("doc_id", F.explode(F.split(text, "\n")).alias("line"))
    amount = first_match(F.col("line"), dated, 3)
    bad_date = checked_date(F.regexp_extract("line", dated, 1)).isNull()
    bad_amount = amount.isNotNull() & german_amount_or_null(amount).isNull()
    return lines.where(F.col("line").rlike(dated) & (bad_date | bad_amount))


def balances(text: Column) -> Column:
    """First match of each balance; NULL where none is found or it is no number."""
    return F.struct(
        *[
            german_amount_or_null(first_match(text, pattern(regex))).alias(name)
            for name, regex in BALANCES.items()
        ]
    )
