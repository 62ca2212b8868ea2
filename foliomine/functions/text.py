"""Patterns, trimming, and German amounts and dates."""

import re

from pyspark.sql import Column, functions as F

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


# The letters of the patterns, and what they are where case is ignored. Java folds the ends of
# a range for every character, so a pattern without other letters does better with the latter.
LETTERS = "[A-Za-zäöüÄÖÜß]"
ALL_CASES = "[A-Za-zäöüÄÖÜßİıſ\u212a]"
# Runs that are followed by what they can't hold: given back piece by piece, they match no more.
_WHOLE_RUNS = [
    (LETTERS + r"+\s+", LETTERS + r"++\s+"),
    (LETTERS + r"+)\s*\n", LETTERS + r"++)\s*\n"),
    (r"\s+" + LETTERS, r"\s++" + LETTERS),
]


def _faster(regex: str, ignore_case: bool) -> tuple[str, bool]:
    """A pattern with the same matches, and whether it still has to ignore case."""
    if "|" not in regex and regex.startswith(f"({LETTERS}+\\s+"):
        # From inside a run of letters there is a match only if there is one from its start.
        regex = rf"(?:\G|(?<!{LETTERS}))" + regex
    for run, whole in _WHOLE_RUNS:
        regex = regex.replace(run, whole)
    rest = re.sub(r"\\[sdnG]", "", regex.replace(LETTERS, ""))
    if ignore_case and LETTERS in regex and not re.search(r"[^\W\d_]|\\", rest):
        return regex.replace(LETTERS, ALL_CASES), False
    return regex, ignore_case


def pattern(regex: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """A Java regex whose classes are Unicode and whose only line end is \\n.

    Without these flags Java takes \\s and \\d as ASCII, folds only ASCII case
    and lets ``.`` and ``$`` stop at \\r.
    """
    regex, ignore_case = _faster(regex, ignore_case)
    flags = "Ud" + ("i" if ignore_case else "") + ("m" if multiline else "")
    return f"(?{flags}){regex}"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def all_matches(text: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def last_match(text: Column, regex: str, group: int = 1) -> Column:
    """Group of the last match, NULL when nothing matches."""
    return F.try_element_at(all_matches(text, regex, group), F.lit(-1))


def first_match(text: Column, regex: str, group: int = 1) -> Column:
    """Group of the first match, NULL when nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, regex, group), F.lit(""))


def _german_number(amount: Column) -> Column:
    return F.translate(amount, ",.", ".").try_cast("double")


def german_amount(amount: Column) -> Column:
    """``1.012,34 EUR`` to 1012.34. Text that is no number gives 0.0."""
    bare = strip(F.replace(F.replace(amount, F.lit("EUR")), F.lit("€")))
    return F.coalesce(_german_number(bare), F.lit(0.0))


def german_amount_or_null(amount: Column) -> Column:
    return _german_number(amount)


def german_cents(amount: Column) -> Column:
    """The exact form of an amount: whole cents."""
    return (F.translate(amount, ",.", ".").try_cast("decimal(38,2)") * 100).cast("bigint")


def iso_date(text: Column) -> Column:
    """``1.2.2024`` to ``2024-02-01`` without a calendar check; other text unchanged."""
    parts = F.split(text, r"\.")

    def two_digits(part: Column) -> Column:
        return F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part)

    day, month, year = (strip(F.get(parts, F.lit(i))) for i in range(3))
    return F.when(
        F.size(parts) == 3,
        F.concat_ws("-", year, two_digits(month), two_digits(day)),
    ).otherwise(text)


def checked_date(text: Column) -> Column:
    """``dd.MM.yyyy`` to a date, NULL for a day the calendar does not have."""
    return F.try_to_date(text, "dd.MM.yyyy")


def clean_field(key: Column, value: Column) -> Column:
    """Field text in its standard form, chosen by the field's name."""
    return (
        F.when(key.rlike("amount|balance|total"), german_amount(value).cast("string"))
        .when(key.rlike("date|period"), iso_date(value))
        .otherwise(value)
    )
