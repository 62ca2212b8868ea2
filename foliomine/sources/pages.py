"""Page text and page layout."""

from pyspark.sql import Column, DataFrame, functions as F

from foliomine.functions.text import strip
from foliomine.schema import WORD

LINES_PER_PAGE = 40


def split_pages(documents: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """``(doc_id, page_no, text)``: the text cut after every ``lines_per_page`` lines."""
    lines = F.split("text", "\n")
    cut = documents.select("doc_id", lines.alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(lines_per_page))
    pages = F.transform(
        starts, lambda s: F.array_join(F.slice("lines", s, F.lit(lines_per_page)), "\n")
    )
    return cut.select("doc_id", F.posexplode(pages).alias("page", "text")).select(
        "doc_id", (F.col("page") + 1).alias("page_no"), "text"
    )


def first_page(text: Column, lines_per_page: int = LINES_PER_PAGE) -> Column:
    """Text of page one, without cutting the other pages."""
    return F.substring_index(text, "\n", lines_per_page)


def join_pages(pages: DataFrame, skip_empty: bool = False) -> DataFrame:
    """``(doc_id, text)``: the pages of each document in order.

    By default every page ends with a newline and the whole is trimmed. With
    ``skip_empty`` the non-empty pages are set apart by a blank line. The text
    of a document is one value, so a document has to fit a row.
    """
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]
    )
    if skip_empty:
        joined = F.array_join(F.filter(ordered, lambda t: F.length(t) > 0), "\n\n")
    else:
        joined = strip(F.array_join(ordered, "\n"))
    return pages.groupBy("doc_id").agg(joined.alias("text"))


class PlainLayout(str):
    """SQL for the words of a plain text's layout, which ``lines``, SQL for its lines with
    their words set apart by one space, say too."""

    lines: str


def words_from_text(text: str) -> PlainLayout:
    """SQL for the layout of the plain text in column ``text``: line i of n is i/n down,
    word j of m is j/m across. The one-element arrays bind the lines and a
    line's words to a name, so each text and line is split once."""
    word = (
        "named_struct('line_no', i, 'word_no', j, 'text', w, 'x0', j / size(ws),"
        " 'top', i / size(ls), 'x1', (j + 1) / size(ws), 'bottom', (i + 1) / size(ls))"
    )
    line_words = (
        "flatten(transform(array(filter(split(l, ' '), w -> w <> '')),"
        f" ws -> transform(ws, (w, j) -> {word})))"
    )
    words = PlainLayout(
        f"CAST(flatten(flatten(transform(array(split({text}, '\\n')),"
        f" ls -> transform(ls, (l, i) -> {line_words})))) AS array<{WORD}>)"
    )
    plain = "contains(l, '  ') OR startswith(l, ' ') OR endswith(l, ' ')"
    one_space = f"CASE WHEN {plain} THEN array_join(filter(split(l, ' '), w -> w <> ''), ' ') ELSE l END"
    words.lines = f"transform(split({text}, '\\n'), l -> {one_space})"
    return words


def gather_words(words: DataFrame) -> DataFrame:
    """Word rows to ``(doc_id, page_no, words)``, a row per page, in reading order.

    Each word is moved once however many zones it falls into. A group is one page of
    one document, which is one value of every zone operator.
    """
    fields = ["line_no", "word_no", "text", "x0", "top", "x1", "bottom"]
    return (
        words.groupBy("doc_id", "page_no")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).cast(f"array<{WORD}>").alias("words"))
    )
