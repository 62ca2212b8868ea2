"""Search of many short strings in many texts by an index of their grams.

Each needle, a list of strings that a text has to hold, is indexed once: by the gram of
it that the fewest needles have. A text is looked up by its own distinct grams, so a text
meets the needles it may hold and no others. An index of few needles is a local table that
Spark may broadcast, so that texts stay where they are. One of many needles is joined and
never collected; its grams are longer, as a short one would be in too many needles, and
of a text only grams of a form that the index has are moved.

Where only the first in rank of few needles is asked for, :func:`with_first` finds it inside
the text's row, by patterns made of the needles.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

GRAM = 3
FEW = 20_000
LONG_GRAMS = (1, 2, 3, 4, 5, 6, 7, 8, 12)
MAX_FORMS = 200
MAX_LENGTH = 100  # of a needle in a pattern
PARTS = (1, 2, 3, 4, 6, 8, 16)  # of the needles in rank order, each part with a pattern
_FORM = {"L": r"\p{L}", "9": r"\p{Nd}", "-": r"[^\p{L}\p{Nd}]"}


def fold(text: Column) -> Column:
    """Lower case in which all forms of a letter that patterns take as equal are equal."""
    return F.translate(F.lower(F.translate(text, "İ", "i")), "ıſςµ", "isσμ")


def grams(text: Column, size: int) -> Column:
    """All overlapping runs of ``size`` characters, found in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def needle_grams(pieces: Column, sizes: tuple[int, ...]) -> Column:
    """The grams of a needle: those of each piece in the largest of ``sizes`` that it has."""

    def own(piece: Column) -> Column:
        cases = F.array().cast("array<string>")
        for size in sizes:
            cases = F.when(F.length(piece) >= size, grams(piece, size)).otherwise(cases)
        return cases

    return F.array_distinct(F.flatten(F.transform(pieces, own)))


def index(needles: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """``(needle, gram)`` of ``needles(needle, pieces)``: the rarest gram of each, short ones
    where there is no other."""
    grams = needles.select("needle", F.explode(needle_grams(F.col("pieces"), sizes)).alias("gram"))
    held = grams.groupBy("gram").agg(F.count("*").alias("n"))
    short = -F.least(F.length("gram"), F.lit(GRAM))
    best = F.min(F.struct(short, "n", -F.length("gram"), "gram"))
    rarest = grams.join(held, "gram").groupBy("needle").agg(best.alias("g"))
    return rarest.select("needle", F.col("g.gram").alias("gram"))


def form(gram: Column) -> Column:
    """A gram with each letter, digit and other character replaced by a sign of its kind."""
    letters = F.regexp_replace(gram, r"\p{L}", "L")
    return F.regexp_replace(F.regexp_replace(letters, r"\p{Nd}", "9"), "(?s)[^L9]", "-")


def text_grams(text: Column, sizes: list[int], forms: list[str] | None = None) -> Column:
    """The distinct grams of a text in ``sizes``, of ``forms`` alone where they are given (then
    every size has one)."""
    found = [F.array().cast("array<string>")]
    for size in sizes:
        kinds = ["".join(_FORM[c] for c in f) for f in forms or [] if len(f) == size]
        regex = "|".join(kinds) if forms else f".{{{size}}}"
        found.append(F.regexp_extract_all(text, F.lit(f"(?s)(?=({regex}))"), F.lit(1)))
    return F.array_distinct(F.concat(*found))


def candidates(texts: DataFrame, needles: DataFrame, few: int = FEW) -> DataFrame:
    """``texts(text_id, text, ...)`` with ``needle``: a row for each of the needles whose
    index gram the text holds; whether it holds the rest is to be checked. Texts and pieces
    are folded alike; empty pieces are not allowed, ids are unique."""
    spark = texts.sparkSession
    many = needles.limit(few + 1).count() > few
    listed = index(needles, LONG_GRAMS if many else tuple(range(1, GRAM + 1)))
    if not many:
        table = listed.toArrow()
        sizes = sorted({len(g) for g in table["gram"].to_pylist()})
        held = texts.select("*", F.explode_outer(text_grams(F.col("text"), sizes)).alias("gram"))
        return held.join(spark.createDataFrame(table), "gram").select(*texts.columns, "needle")
    forms = [r["f"] for r in listed.select(form(F.col("gram")).alias("f")).distinct().limit(MAX_FORMS + 1).collect()]
    if len(forms) <= MAX_FORMS:
        own = text_grams(F.col("text"), sorted({len(f) for f in forms}), sorted(forms))
    else:
        own = text_grams(F.col("text"), list(LONG_GRAMS))
    held = texts.select("text_id", F.explode_outer(own).alias("gram"))
    found = held.join(listed, "gram").select("text_id", "needle")
    return texts.join(found, "text_id").select(*texts.columns, "needle")


def _trie(ranked: list[str]) -> dict:
    """Needles in the order of their rank as nested maps of characters; "" ends one. A needle
    that begins with a better one is left out, as a text that holds it holds that one too."""
    root: dict = {}
    for needle in ranked:
        node = root
        for c in needle:
            if "" in node:
                break
            node = node.setdefault(c, {})
        else:
            node[""] = {}
    return root


def _sign(c: str) -> str:
    return c if c.isascii() and c.isalnum() else rf"\x{{{ord(c):x}}}"


def _alternatives(node: dict, signs: list[str]) -> str:
    """Many signs are told apart by halves."""
    if len(signs) <= 4:
        return "|".join(_sign(c) + _branches(node[c]) for c in signs)
    half = len(signs) // 2
    lower = f"(?=[{_sign(signs[0])}-{_sign(signs[half - 1])}])(?:{_alternatives(node, signs[:half])})"
    return f"{lower}|{_alternatives(node, signs[half:])}"


def _branches(node: dict) -> str:
    signs = sorted(c for c in node if c)
    if not signs:
        return ""
    if len(signs) == 1 and "" not in node:
        return _alternatives(node, signs)
    return f"(?:{_alternatives(node, signs)})" + "?" * ("" in node)


def trie_pattern(ranked: list[str]) -> str:
    """A pattern whose group 1 is, at each place of a text where one of the needles begins, the
    first of them in rank: one that is left beginning with another comes before it in rank,
    so it is the longest. Places with too few characters before the next space are passed by."""
    room = 0 if any(" " in needle for needle in ranked) else min(map(len, ranked))
    return f"(?=(?=[^ ]{{{room}}})({_branches(_trie(ranked))}))"


def _first_inside(root: dict, ranks: dict[str, int], word: str) -> int:
    """The least rank of a needle of the trie inside the word; their number where there is none."""
    best = len(ranks)
    for i in range(len(word)):
        node = root
        for j in range(i, len(word)):
            node = node.get(word[j])
            if node is None:
                break
            if "" in node:
                best = min(best, ranks[word[i : j + 1]])
    return best


def _lookup(values: dict[str, int]) -> Callable[[Column], Column]:
    """The value of a string, NULL where there is none, from a literal of the plan: an array of
    small maps, as Spark reads through a map from its start."""
    buckets: list[dict] = [{} for _ in range(len(values) // 2 + 1)]
    for key, value in values.items():
        buckets[zlib.crc32(key.encode()) % len(buckets)][key] = value
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
    return lambda key: F.try_element_at(F.get(table, (F.crc32(key) % len(buckets)).cast("int")), key)


def with_first(texts: DataFrame, text: Column, ranked: list[str], name: str) -> DataFrame:
    """``texts`` with the column ``name``: the least place in ``ranked`` of a needle that the
    text holds, their number where it holds none. The needles are distinct, not empty and of
    ``MAX_LENGTH`` characters at most.

    Nothing is shuffled and no row is copied. A text's distinct words are looked up among the
    needles. Those that are none are searched by a pattern of the needles that come before
    what was found, and only those that are as long as the shortest of these. Needles with a
    space in them are sought in the whole text.
    """
    n = len(ranked)
    if not n:
        return texts.withColumn(name, F.lit(0))
    ranks = {needle: i for i, needle in enumerate(ranked)}
    root = _trie(ranked)
    inside = _lookup({needle: _first_inside(root, ranks, needle) for needle in ranked})
    inner = [needle for needle in ranked if " " not in needle]
    across = [needle for needle in ranked if " " in needle]
    words, firsts, best, hits, line = (f"_{part}_{name}" for part in ("words", "firsts", "best", "hits", "line"))

    def no_needles(shortest: int) -> Column:
        long = lambda w, i: F.get(firsts, i).isNull() & (F.length(w) >= shortest)
        return F.array_join(F.filter(words, long), " ")

    found = F.array().cast("array<string>")
    for of in PARTS:
        if better := inner[: -(-len(inner) // of)]:
            sought = F.regexp_extract_all(no_needles(min(map(len, better))), F.lit(trie_pattern(better)), F.lit(1))
            # All needles that come before the best known one are in the part if that one is.
            found = sought if of == 1 else F.when(F.col(best) <= ranks[better[-1]], sought).otherwise(found)
    if across:
        found = F.concat(found, F.regexp_extract_all(line, F.lit(trie_pattern(across)), F.lit(1)))
    looked_up = (
        texts.withColumn(line, text)
        .withColumn(words, F.array_distinct(F.split(line, " ")))
        .withColumn(firsts, F.transform(words, inside))
        .withColumn(best, F.coalesce(F.array_min(firsts), F.lit(n)))
        .withColumn(hits, found)
    )
    first = F.least(F.col(best), F.array_min(F.transform(hits, inside)))
    return looked_up.select(*texts.columns, first.alias(name))
