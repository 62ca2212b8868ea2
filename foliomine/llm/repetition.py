"""Quality rules on repetition: how much of a text lies inside repeated n-grams
and lines.

All counts come from rolling hashes of one text's words and lines as numpy arrays:
the n-grams of each length are counted by their hash, and the words inside counted
n-grams are marked by a running sum, so a character is measured once however many
n-grams cover it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliomine.llm.words import as_bytes, ngram_hashes, range_hashes, spans

# Most of a text's word characters, in per cent, that may lie in the occurrences of
# the most frequent n-gram (n of 2 to 4, three occurrences at least), and inside
# n-grams that occur twice or more (n of 5 to 10).
TOP_LIMITS = {2: 20, 3: 18, 4: 16}
DUPLICATE_LIMITS = {5: 25, 6: 24, 7: 23, 8: 22, 9: 21, 10: 20}
# The same for characters of lines that repeat an earlier line.
LINE_LIMIT = 30
MIN_WORDS = 10

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
MEASURES = (
    COUNTS + [f"top{n}_chars" for n in TOP_LIMITS] + [f"dup{n}_chars" for n in DUPLICATE_LIMITS]
)


def _covered(marks: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Words inside the marked n-grams."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    at = np.flatnonzero(marks)
    step[at] += 1
    np.subtract.at(step, at + n, 1)
    return np.cumsum(step[:-1]) > 0


def measure(text: str | bytes | None) -> list[int]:
    """The ``MEASURES`` of a text; all zero for a null or empty one."""
    data = as_bytes(text)
    first, past = spans(data)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]).astype(np.int64)
    chars = points[past] - points[first]
    words = range_hashes(data, first, past)
    n_words, symbols = len(words), int(_SYMBOL[data].sum())
    total = int(chars.sum())

    ends = np.append(np.flatnonzero(data == 0x0A), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    word_before = np.searchsorted(first, starts)
    in_line = np.searchsorted(first, ends) - word_before
    written = in_line > 0
    lines = range_hashes(data, starts[written], ends[written])
    _, where = np.unique(lines, return_index=True)
    repeated = np.ones(len(lines), dtype=bool)
    repeated[where] = False
    word_points = np.concatenate([[0], np.cumsum(chars)])
    lo = word_before[written]
    line_chars = word_points[lo + in_line[written]] - word_points[lo]

    # An n-gram is no more frequent than the shorter ones inside it, so a length
    # without any frequent n-gram ends the search among longer ones.
    top, duplicate, repeat_words, most, twice = [], [], 0, n_words, True
    for n in (*TOP_LIMITS, *DUPLICATE_LIMITS):
        grams = ngram_hashes(words, n)
        if len(grams) < 2 or (most < 3 if n in TOP_LIMITS else not twice):
            (top if n in TOP_LIMITS else duplicate).append(0)
            continue
        _, index, counts = np.unique(grams, return_inverse=True, return_counts=True)
        if n in TOP_LIMITS:
            most = int(counts.max())
            best = 0
            if most >= 3:
                # Of equally frequent n-grams the one that covers the most characters.
                own = np.convolve(chars, np.ones(n, dtype=np.int64), "valid")
                sums = np.bincount(index, weights=own)
                gram = int(np.argmax(np.where(counts == most, sums, -1)))
                best = int(chars[_covered(index == gram, n, n_words)].sum())
            top.append(best)
            continue
        inside = _covered(counts[index] > 1, n, n_words)
        twice = bool(inside.any())
        duplicate.append(int(chars[inside].sum()))
        if n == 5:
            repeat_words = int(inside.sum())
    found = [n_words, total, symbols, int(repeated.sum()), repeat_words]
    return [*found, int(line_chars[repeated].sum()), *top, *duplicate]


def with_measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``MEASURES`` of the whole ``text``, a row per row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def check_repetition(docs: DataFrame) -> DataFrame:
    """The measures of each document with ``base_failed`` and ``kept``.

    Uses ``doc_id`` and ``text``. A null, empty or white-space text has zero in every
    measure and fails for having fewer than ten words. Equal rows get equal results,
    a null doc_id is passed through, and an empty table gives an empty result.
    """
    rows = with_measures(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * 20
    )
    limits = {f"top{n}_chars": v for n, v in TOP_LIMITS.items()}
    limits |= {f"dup{n}_chars": v for n, v in DUPLICATE_LIMITS.items()}
    limits["dup_line_chars"] = LINE_LIMIT
    repetitive = F.lit(False)
    for name, percent in limits.items():
        repetitive = repetitive | (F.col(name) * 100 > F.col("word_chars") * percent)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repetitive)
