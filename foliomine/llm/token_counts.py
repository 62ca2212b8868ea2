"""Token counts by a two-tier lookup of pre-token lengths.

The tokenizer drops white space and merges inside pre-tokens only, so a text's tokens are
the sum over its pre-tokens. The first tier is one table of frequent pre-tokens and their
lengths in tokens, broadcast once; what it lacks is looked up in a cache of the Python
worker and, where that lacks it too, encoded by the library and cached. Nothing but ids
and counts leaves a task: no pre-token is shuffled, and every text is read whole.

Pre-tokens are split by a pattern here, for runs of the characters of which the
splitting, composing and lower-casing are sure to agree with the library's in any version
of Unicode. A run of other characters up to the next white space (white space ends a
pre-token and composes with nothing) is one key of the cache and is left to the library
whole, with the special strings it may hold.

The table only saves time: counts are the same whatever it holds. It is learned from a
bounded sample of documents.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

# How the supported tokenizer normalises and splits.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

SLICE = 1 << 20  # characters of a text that are split at once
SAMPLE_DOCS = 2048  # documents the table is learned from
SAMPLE_BYTES = 1 << 16  # the longest one of them
TABLE = 1 << 15  # pre-tokens of the table
CACHE = 1 << 18  # pre-tokens of a worker's cache; it is emptied when full
LONGEST = 64  # characters of a pre-token that is kept in the table or a cache

_SPACE = re.compile(r"[\x20\x09-\x0D]")
_PLAIN = "\x21-\x7E\xA1\xA7\xAB\xB0\xBB\xBF-\xFF–—‘’“”…€"
_LETTERS = "a-z\xC0-\xD6\xD8-\xF6\xF8-\xFF"
_ODD = re.compile(rf"[^\x20\x09-\x0D{_PLAIN}]|<\|")
_ODD_RUN = re.compile(rf"[^\x20\x09-\x0D]*?(?:[^\x20\x09-\x0D{_PLAIN}]|<\|)[^\x20\x09-\x0D]*")
_PIECES = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\x20\x09-\x0D0-9{_LETTERS}]+")


@dataclass(frozen=True)
class Settings:
    tokenizer: str  # path of the tokenizer's .json file, on the driver
    max_tokens: int = 2048
    sample_docs: int = SAMPLE_DOCS


def read_tokenizer(path: str) -> str:
    """The tokenizer's definition, checked to be of the supported kind."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    known = json.loads(definition)
    steps = (known.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = {"pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    added = known.get("added_tokens") or []
    if (
        known.get("normalizer") != NORMALIZER
        or any(steps[0].get(k) != v for k, v in split.items())
        or any(s["type"] != "ByteLevel" or s["use_regex"] or s["add_prefix_space"] for s in steps[1:])
        or any(not a["content"].startswith("<|") or _SPACE.search(a["content"]) for a in added)
        or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
    ):
        raise ValueError(f"{path}: its normalizer, splitting or added tokens differ from the supported ones")
    return definition


def _slices(text: str) -> Iterator[str]:
    """The text in slices that end at white space."""
    start = 0
    while len(text) - start > SLICE:
        space = _SPACE.search(text, start + SLICE)
        if not space:
            break
        yield text[start : space.start()]
        start = space.start()
    yield text[start:]


def pre_tokens(text: str) -> list[str]:
    """Keys whose token counts add up to that of the text."""
    odd = []
    if _ODD.search(text):
        odd = _ODD_RUN.findall(text)
        text = _ODD_RUN.sub(" ", text)
    return _PIECES.findall(text.lower()) + odd


class Encoder:
    """The library's tokenizer behind a cache of lengths."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, int] = {}

    def lengths(self, keys: list[str]) -> dict[str, int]:
        """The number of tokens of each key."""
        missing = [k for k in keys if k not in self.cache]
        found = {k: self.cache[k] for k in keys if k in self.cache}
        if missing:
            encoded = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
            found |= {k: len(e) for k, e in zip(missing, encoded)}
            if len(self.cache) > CACHE:
                self.cache.clear()
            self.cache.update((k, found[k]) for k in missing if len(k) <= LONGEST)
        return found

    def count(self, text: str, table: dict[str, int]) -> int:
        total = 0
        for part in _slices(text):
            keys = pre_tokens(part)
            known = list(map(table.get, keys))
            if None in known:
                misses = Counter(k for k, n in zip(keys, known) if n is None)
                own = self.lengths(list(misses))
                total += sum(n * own[k] for k, n in misses.items())
                known = filter(None, known)
            total += sum(known)
        return total


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, definition: str) -> Encoder:
    """The tokenizer and cache of this Python worker."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def frequent(docs: DataFrame, definition: str, sample_docs: int = SAMPLE_DOCS) -> dict[str, int]:
    """Lengths of the ``TABLE`` most frequent pre-tokens of a sample of about
    ``sample_docs`` documents, none over ``SAMPLE_BYTES``. The sample meets in one task."""
    n = docs.count()
    if not n:
        return {}
    rows = docs.select("text").sample(min(1.0, sample_docs / n), seed=11)
    rows = rows.where(F.octet_length("text") <= SAMPLE_BYTES).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(k for k in pre_tokens(text) if len(k) <= LONGEST)
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:TABLE]
        own = Encoder(definition).lengths([k for k, _ in top])
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int32())], ["key", "n"]
        )

    return {r["key"]: r["n"] for r in rows.mapInArrow(run, "key string, n int").collect()}


def _shared(spark: SparkSession, docs: DataFrame, settings: Settings) -> Broadcast:
    """Definition and table; both of bounded size."""
    definition = read_tokenizer(settings.tokenizer)
    table = frequent(docs, definition, settings.sample_docs)
    return spark.sparkContext.broadcast((definition, table))


def count_tokens(docs: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, a row per row of ``docs``.

    Uses ``doc_id`` and ``text``; other columns, whatever their names, are left alone.
    Tokens are counted as the library gives them without begin, end or added special
    tokens; special strings inside a text are one token each, as by its default. A null text
    counts as an empty one, with 0 bytes and tokens; so does white space with 0 tokens. A null doc_id is passed
    through, equal rows get equal results, an empty table gives an empty result. A text
    is read in slices of about ``SLICE`` characters that end at white space, so memory
    grows with the longest run without white space, not with the text.
    """
    shared = _shared(docs.sparkSession, docs, settings)
    schema = "doc_id long, n_bytes long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, table = shared.value
        encoder = _encoder(definition, definition)
        for batch in batches:
            counts = [encoder.count(t.as_py() or "", table) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select("doc_id", n_bytes, "text").mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > settings.max_tokens)
