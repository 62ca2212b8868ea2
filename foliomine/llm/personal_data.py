"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over the text once and finds anchors: at signs, plus
signs, digits, schemes and identifier cues. Around each anchor a deterministic local
parser expands to the boundaries of one kind and validates what it finds. A parser
never reads further left than the end of the last match of its kind, so the spans of
a kind do not overlap and come in order, as those of a leftmost scan do.

Spans are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("account", "iban", "secret", "url_user")
KINDS = BASE_KINDS + EXTRA_KINDS

# Cues, in lower case, that announce an identifier behind them.
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "ssn", "customer no")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "akia")
# Characters behind the cue of an IBAN that are read across ends of lines; from there
# on it is sought to the end of the line.
IBAN_NEAR = 60

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = frozenset("0123456789")
_SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_/+=.-]{8,})")
_ACCESS_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_ACCOUNT = re.compile(r"(?:\s{0,3}(?:no\.?|nr\.?|number|id|#))?\s{0,3}[:=#]?\s{0,3}([A-Z]{0,3}[0-9][0-9-]{4,17}[0-9])(?![0-9A-Za-z])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){3,8}")
_URL_USER = re.compile(r"://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")


@lru_cache(maxsize=1)
def _automaton():
    """Anchors with the kind of parser that each one starts."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for digit in "0123456789":
        automaton.add_word(digit, ("digit", 1))
    automaton.add_word("@", ("at", 1))
    automaton.add_word("+", ("plus", 1))
    automaton.add_word("://", ("scheme", 3))
    automaton.add_word("iban", ("iban", 4))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            automaton.add_word(cue, (kind, len(cue)))
    automaton.make_automaton()
    return automaton


_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = ord(d) - 48
        if k % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def passes_iban(text: str) -> bool:
    code = text.replace(" ", "")
    if not 15 <= len(code) <= 34:
        return False
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of all personal data of a text, by kind as in ``KINDS``
    and then by start; nothing for a null or empty text."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)  # how far each parser has read
    if not text:
        return []

    def take(kind: str, start: int, end: int, valid: bool) -> None:
        past[kind] = end
        if valid:
            spans[kind].append((start, end))

    def near(kind: str, match: re.Match | None, group: int = 0) -> bool:
        if match is None or match.start(group) < past[kind]:
            return False
        take(kind, match.start(group), match.end(group), True)
        return True

    folded = text.lower()
    if len(folded) != len(text):  # a letter whose lower case is longer
        folded = text.translate(_FOLD)
    for last, (anchor, length) in _automaton().iter(folded):
        first = last - length + 1
        if anchor == "digit":
            if first >= past["card"] and (match := _CARD.match(text, first)):
                digits = match.group().replace(" ", "").replace("-", "")
                take("card", first, match.end(), 16 <= len(digits) <= 19 and passes_luhn(digits))
            if first >= past["ip"]:
                if match := _IP.match(text, first):
                    parts = match.group().split(".")
                    take("ip", first, match.end(), all(_small(p) for p in parts))
                else:  # no match can start at a later digit of this run either
                    end = first
                    while end < len(text) and text[end] in _DIGITS:
                        end += 1
                    past["ip"] = end
        elif anchor == "at":
            if first < past["email"]:
                continue
            start = first
            while start > past["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < first and (match := _DOMAIN.match(text, first)):
                take("email", start, match.end(), True)
        elif anchor == "plus":
            if first >= past["phone"] and (match := _PHONE.match(text, first)):
                n = sum(c in _DIGITS for c in match.group())
                take("phone", first, match.end(), 8 <= n <= 15)
        elif anchor == "scheme":
            near("url_user", _URL_USER.match(text, first))
        elif anchor == "iban":
            # To the end of a line, each stretch once however many cues stand before it.
            if last + IBAN_NEAR > past["iban"]:
                end = text.find("\n", last + IBAN_NEAR)
                end = len(text) if end < 0 else end
                at = max(last + 1, past["iban"])
                while match := _IBAN.search(text, at, end):
                    code = match.group()
                    while len(code) >= 15 and not passes_iban(code):
                        code = code[:-1].rstrip()
                    at = match.start() + (len(code) if len(code) >= 15 else 1)
                    if len(code) >= 15:
                        take("iban", match.start(), at, True)
                past["iban"] = end
        elif anchor == "account":
            if not text[first - 1 : first].isalnum():
                near("account", _ACCOUNT.match(text, last + 1), 1)
        elif length == 4 and folded.startswith("akia", first):
            near("secret", _ACCESS_KEY.match(text, first))
        elif not text[first - 1 : first].isalnum():
            near("secret", _SECRET.match(text, last + 1), 1)
    return [(k, start, end) for k in KINDS for start, end in spans[k]]


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{start}:{end}" for k, start, end in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>`` of each document's ``text``.

    Kinds and order are those of ``KINDS``. A null or empty text has no spans, equal
    rows get equal results, a null doc_id is passed through, and an empty table
    gives an empty result. Other columns are not read.
    """

    @F.pandas_udf("array<struct<kind string, start long, end long>>")
    def spans_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(
                [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in batch], dtype=object
            )

    return docs.select("doc_id", spans_of("text").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and one text per document of the spans of :func:`find_personal_data`."""

    def text_of(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def count_of(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [count_of(k) for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.size(spans).cast("long").alias("n_spans"),
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(spans).alias("spans"),
    )


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; where spans
    overlap, the one that starts first (of two, the longer) covers the others."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])
