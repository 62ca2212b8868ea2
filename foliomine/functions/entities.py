"""Date and amount entities found in free text."""

from pyspark.sql import Column, functions as F

from .text import all_matches, pattern

# The entity patterns, in the order their results are listed.
DATE_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}\.\d{2}\.\d{4}",
    r"\d{2}/\d{2}/\d{4}",
]
AMOUNT_PATTERNS = [
    r"\$\s*\d+(?:,\d{3})*(?:\.\d{2})?",
    r"€\s*\d+(?:,\d{3})*(?:\.\d{2})?",
    r"\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:EUR|USD|€|\$)",
]
# What a text with a match of the pattern holds one of: a search for it costs little, and most
# texts have none of some.
_NEEDED = dict(zip(DATE_PATTERNS + AMOUNT_PATTERNS, ("-", ".", "/", "$", "€", ("EUR", "USD", "€", "$"))))
BASIC_DATE_PATTERN = r"\d{4}-\d{2}-\d{2}"
BASIC_AMOUNT_PATTERN = r"\$\d+(?:\.\d{2})?(?:\s*(?:USD|EUR|GBP))?"


def _bag(text: Column, patterns: list[str]) -> Column:
    """Matches of all patterns, pattern by pattern, duplicates kept."""

    def matches(p: str) -> Column:
        possible = F.lit(False)
        for needed in _NEEDED.get(p, ("",)):
            possible = possible | text.contains(needed)
        # A NULL text has neither.
        return F.when(possible, all_matches(text, pattern(p))).when(~possible, empty_strings())

    return F.concat(*map(matches, patterns))


def dates(text: Column) -> Column:
    return _bag(text, DATE_PATTERNS)


def amounts(text: Column) -> Column:
    return _bag(text, AMOUNT_PATTERNS)


def basic_dates(text: Column) -> Column:
    return _bag(text, [BASIC_DATE_PATTERN])


def basic_amounts(text: Column) -> Column:
    return _bag(text, [BASIC_AMOUNT_PATTERN])


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def entities(found_dates: Column, found_amounts: Column) -> Column:
    """The entity struct; people and organizations only ever come from an AI reply."""
    return F.struct(
        empty_strings().alias("people"),
        empty_strings().alias("organizations"),
        F.coalesce(found_dates, empty_strings()).alias("dates"),
        F.coalesce(found_amounts, empty_strings()).alias("amounts"),
    )


def any_entity(entities: Column) -> Column:
    names = ("people", "organizations", "dates", "amounts")
    return sum((F.size(entities[n]) for n in names), F.lit(0)) > 0
