"""Category of a transaction by the first keyword list that hits."""

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# Categories and their keywords, in the order they are tried.
CATEGORY_KEYWORDS = {
    "rent": ["miete", "mietvertrag", "wohnung"],
    "insurance": ["versicherung", "allianz", "uniqa", "nurnberger", "huk", "lebensvers"],
    "utilities": ["strom", "gas", "wasser", "stadtwerke", "lekker energie"],
    "salary": ["gehalt", "lohn", "einkommen"],
    "transfer": ["überweisung", "dauerauftrag", "gutschrift"],
    "cash": ["bargeld", "atm", "geldautomat", "bargeldauszahlung"],
    "subscription": ["abo", "netflix", "spotify", "itunes", "google", "medium monthly"],
    "transportation": ["uber", "taxi", "bvg", "deutsche bahn", "mytaxi", "flug", "ratp"],
    "shopping": ["edeka", "rewe", "kaufland", "zara", "esprit", "amazon"],
    "dining": ["restaurant", "café", "coffee", "marche", "bailli"],
    "travel": ["hotel", "booking", "airbnb", "flug", "bahn"],
    "healthcare": ["apotheke", "arzt", "klinik", "medical"],
    "donation": ["spende", "umwelthilfe", "grundeinkommen"],
}

SHORT_LIST = 32  # keywords that are tried one by one and not as a pattern


def category(
    description: Column,
    keywords: dict[str, list[str]] | list[tuple[str, list[str]]] = CATEGORY_KEYWORDS,
) -> Column:
    """First category with a keyword inside the description, else ``other``. A category
    may come several times in a list of keyword lists.

    A CASE over keyword tests: no join, no copy of the row per keyword. The array of one
    element binds the lowered text to a name, so it is made once.
    """

    def holds(lowered: Column, words: list[str]) -> Column:
        if 0 < len(words) <= SHORT_LIST:
            return reduce(or_, [lowered.contains(w) for w in words])
        return lowered.rlike("|".join(re.escape(w) for w in words))

    def first(lowered: Column) -> Column:
        cases = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, words in keywords.items() if isinstance(keywords, dict) else keywords:
            cases = cases.when(holds(lowered, words), name)
        return cases.otherwise("other")

    return F.get(F.transform(F.array(F.lower(description)), first), F.lit(0))
