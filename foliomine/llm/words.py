"""Word and n-gram hashes of a text, as numpy arrays over its UTF-8 bytes.

A word is a run of bytes other than space and ``\\x09``-``\\x0D``. Words are
hashed by differences of a polynomial prefix sum modulo 2**64, n-grams by
combining the hashes of their words, so a text costs a fixed number of passes
over its bytes whatever the length of the n-grams.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BYTE_VALUES = np.random.RandomState(20240).randint(1, 2**63 - 1, size=256, dtype=np.int64).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: Bytes that are hashed at once: bounds the tables of powers, whatever a text's length.
WINDOW = 1 << 20

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i below n, grown by doubling and kept for the process."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        steps = np.full(max(n, 1 << 14, 0 if table is None else 2 * len(table)), base, dtype=np.uint64)
        steps[0] = 1
        table = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return table[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of each number over all 64 (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte past the last of every word."""
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def as_bytes(text: str | bytes | None, lower: bool = False) -> np.ndarray:
    """The text's UTF-8 bytes; ``lower`` folds A-Z alone."""
    if text is None:
        return np.zeros(0, dtype=np.uint8)
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(text, dtype=np.uint8)
    return _LOWER[data] if lower else data


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte range, equal for equal bytes. The ranges come in order and
    don't overlap."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    if ends[-1] - starts[0] <= WINDOW:
        at, to = starts[0], ends[-1]
        return _hashes(data[at:to], starts - at, ends - at)
    found = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + WINDOW, side="right"))
        if j > i:
            at, to = starts[i], ends[j - 1]
            found[i:j] = _hashes(data[at:to], starts[i:j] - at, ends[i:j] - at)
        else:  # longer than a window: its pieces' hashes, hashed as an n-gram
            j = i + 1
            pieces = np.arange(starts[i], ends[i], WINDOW)
            parts = [_hashes(data[p : min(p + WINDOW, ends[i])], *_whole(p, ends[i])) for p in pieces]
            found[i] = ngram_hashes(np.concatenate(parts), len(parts))[0]
        i = j
    return found


def _whole(start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(1, dtype=np.int64), np.array([min(WINDOW, end - start)])


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _power_table(_BASE, len(data)), out=prefix[1:])
        inverse = _power_table(_INVERSE, len(data) + 1)
        own = (prefix[ends] - prefix[starts]) * inverse[starts]
        return mix(own + (ends - starts).astype(np.uint64) * _STEP)


def word_hashes(text: str | bytes | None, lower: bool = False) -> np.ndarray:
    """A hash of each word, in order."""
    data = as_bytes(text, lower)
    return range_hashes(data, *spans(data))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, in order; none if there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(count, dtype=np.uint64)
        for k in range(n):
            total = total * _STEP + words[k : k + count]
        return mix(total, n)


def shingle_set(text: str | bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, its A-Z folded.

    A text of fewer words has its whole sequence as one shingle; a text without
    words has none.
    """
    words = word_hashes(text, lower=True)
    if not len(words):
        return words
    return np.unique(ngram_hashes(words, min(n, len(words))))
