"""Key/value pairs in text."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from foliomine.functions.text import all_matches, pattern, strip

_LETTER = "A-Za-zäöüÄÖÜß"

# Two rules: "Key: value" and "Key amount". A key is one whole run of letters
# and space, so a search may only begin where such a run begins or where the
# last match ended, and takes the run in one piece. Tried from every letter, as
# the plain patterns are, a long text without a digit costs its square.
_RUN = rf"(?:\G|(?<![{_LETTER}\s]))"
KEY_COLON_VALUE = _RUN + rf"([{_LETTER}\s]++):\s*([^\n]+)"
_KEY = rf"^[{_LETTER}\s]+"  # of a match of the second rule, up to its first digit
KEY_AMOUNT = _RUN + (
    rf"((?>[{_LETTER}\s]{{2,}})(?<=\s))(\d[\d\s.,]+(?:EUR|€)?(?:\s*p\.a\.)?)"
)


def key_value_pairs(text: Column) -> Column:
    """``array<struct<key, ord, value>>``: all accepted pairs in the order they
    are stored, the colon rule's before the amount rule's."""

    def pairs(rule: str, first: int, key: Callable[[Column], Column], after: int) -> Column:
        """Of each whole match the key and the rest: the text is searched once, and not once
        per group. ``after`` is the length of what stands between; space is stripped."""
        return F.transform(
            F.transform(all_matches(text, pattern(rule)), lambda m: F.struct(m.alias("all"), key(m).alias("k"))),
            lambda m, i: F.struct(
                strip(m["k"]).alias("key"),
                F.struct(F.lit(first).alias("rule"), i.alias("n")).alias("ord"),
                strip(F.substr(m["all"], F.length(m["k"]) + after + 1)).alias("value"),
            ),
        )

    both = F.concat(
        pairs(KEY_COLON_VALUE, 1, lambda m: F.substring_index(m, ":", 1), 1),
        pairs(KEY_AMOUNT, 2, lambda m: F.regexp_extract(m, pattern(_KEY), 0), 0),
    )
    return F.filter(both, lambda p: (F.length(p["key"]) > 2) & (p["value"] != ""))


def last_per_key(pairs: Column) -> Column:
    """The pair stored last under each key, ordered by key.

    Sorted by key and order, a pair is the last of its key when its right
    neighbour has another key, so the array is never compared with itself.
    """

    def keep(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda p, i: ~F.get(ordered, i + 1)["key"].eqNullSafe(p["key"]),
        )

    return F.get(F.transform(F.array(F.sort_array(pairs)), keep), F.lit(0))


def pair_map(text: Column) -> Column:
    last = last_per_key(key_value_pairs(text))
    return F.map_from_entries(
        F.transform(last, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
    )


def pair_rows(documents: DataFrame, text: str = "page_text") -> DataFrame:
    """``(doc_id, key, value)`` rows, last value per key."""
    return documents.select(
        "doc_id", F.inline(last_per_key(key_value_pairs(F.col(text))))
    ).select("doc_id", "key", "value")
