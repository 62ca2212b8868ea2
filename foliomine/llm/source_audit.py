"""Divergence of sources by their terms, with late strings.

Counts are made and shuffled for digests of fixed width, never for terms. A task counts
its terms by language, source and digest in numpy arrays; the counts meet by language and
digest, and only digests with enough documents go on. A second reading of the texts
brings back the strings of those: of each digest the smallest and the largest one, by
task and then over all. Where they differ, terms collide in the digest, and a third
reading counts exactly these by their strings, so the digest's row is split into one per
term. The other rows get their string at the very end, for kept outputs.

Which digests a reading has to look at is told by a bitmap of fixed size; what passes it
by chance drops out in the join that follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliomine.llm.scratch import materialise
from foliomine.llm.words import as_bytes, range_hashes

UNIT = 1_000_000_000
PLUS = 5  # added to every count
BITMAP_BITS = 23
BATCH_BYTES = 4 << 20  # of text that is looked at together
HELD = 1 << 21  # counts that a task holds before it gives them out
STRINGS = 1 << 18  # strings that a task holds
CELLS = 1 << 21  # of a matrix of terms by sources
TILE = 512  # sources that one copy of a term's row is compared for

_TERM = np.zeros(256, dtype=bool)
_TERM[ord("A") : ord("Z") + 1] = _TERM[ord("a") : ord("z") + 1] = _TERM[0x80:] = True


@dataclass(frozen=True)
class Settings:
    min_docs: int = 30
    top: int = 50
    digest_bits: int = 64


class Terms:
    """The terms of some texts: bytes with A-Z folded, where each begins and ends, its text
    and its digest."""

    def __init__(self, texts: list[bytes], bits: int):
        self.data = as_bytes(b"\n".join(texts), lower=True)
        inside = np.zeros(len(self.data) + 2, dtype=np.int8)
        inside[1:-1] = _TERM[self.data]
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.row = np.searchsorted(first, self.starts, side="right") - 1
        digest = range_hashes(self.data, self.starts, self.ends)
        low = np.uint64(64 - bits)
        self.digest = (digest >> low << low).view(np.int64)

    def keep(self, wanted: np.ndarray) -> None:
        for name in ("starts", "ends", "row", "digest"):
            setattr(self, name, getattr(self, name)[wanted])

    def string(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def distinct(self) -> Iterator[tuple[int, bytes]]:
        """Each digest with each of its strings."""
        order = np.argsort(self.digest, kind="stable")
        new = np.ones(len(order), dtype=bool)
        new[1:] = self.digest[order][1:] != self.digest[order][:-1]
        first = order[new]
        sample = np.empty(len(order), dtype=np.int64)
        sample[order] = first[np.cumsum(new) - 1]
        for i in first:
            yield int(self.digest[i]), self.string(i)
        for i in np.flatnonzero(~self._same(sample)):
            yield int(self.digest[i]), self.string(i)

    def _same(self, other: np.ndarray) -> np.ndarray:
        """Whether each term has the bytes of the term ``other``."""
        lengths = self.ends - self.starts
        same = lengths == lengths[other]
        todo = np.flatnonzero(same & (other != np.arange(len(other))))
        sizes = np.cumsum(lengths[todo])
        for i in range(0, int(sizes[-1]) if len(sizes) else 0, BATCH_BYTES // 4):
            part = todo[np.searchsorted(sizes, i, "right") : np.searchsorted(sizes, i + BATCH_BYTES // 4, "right")]
            if not len(part):
                continue
            size = lengths[part]
            begin = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(begin, size)
            equal = (
                self.data[np.repeat(self.starts[part], size) + step]
                == self.data[np.repeat(self.starts[other[part]], size) + step]
            )
            same[part] = np.logical_and.reduceat(equal, begin)
        return same


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Languages, sources and texts of some rows at a time."""
    rows, size = ([], [], []), 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            for column, value in zip(rows, (lang, source, text)):
                column.append(value)
            size += len(text)
            if size >= BATCH_BYTES:
                yield rows
                rows, size = ([], [], []), 0
    if rows[0]:
        yield rows


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows ``group, digest, n, docs`` added up by group and digest."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    new = np.ones(rows.shape[1], dtype=bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    at = np.flatnonzero(new)
    return np.vstack([rows[:2, at], *(np.add.reduceat(rows[i], at)[None] for i in (2, 3))])


def _counts(bits: int):
    """``lang, source, digest, n, docs`` of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        held, n_held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            names = list(groups)
            rows = _summed(held)
            for i in range(0, rows.shape[1], 1 << 16):
                group, digest, n, docs = rows[:, i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([names[g][k] for g in group], pa.string()) for k in (0, 1)),
                        *(pa.array(x, pa.int64()) for x in (digest, n, docs)),
                    ],
                    ["lang", "source", "digest", "n", "docs"],
                )

        for langs, sources, texts in _batches(batches):
            terms = Terms(texts, bits)
            if not len(terms.row):
                continue
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources)])[terms.row]
            order = np.lexsort((terms.row, terms.digest, group))
            group, digest, row = group[order], terms.digest[order], terms.row[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (digest[1:] != digest[:-1])
            new_doc = new.copy()
            new_doc[1:] |= row[1:] != row[:-1]
            at = np.flatnonzero(new)
            n = np.diff(at, append=len(order))
            held.append(np.stack([group[at], digest[at], n, np.add.reduceat(new_doc.astype(np.int64), at)]))
            n_held += len(at)
            if n_held >= HELD:
                yield from out()
                held, n_held = [], 0
        if held:
            yield from out()

    return run


def _wanted(digests: DataFrame) -> Broadcast:
    """A bitmap of ``2 ** BITMAP_BITS`` bits with those of ``digests(digest)`` set."""
    place = F.shiftrightunsigned("digest", 64 - BITMAP_BITS)
    words = digests.select(F.shiftright(place, 6).cast("int").alias("word"), place.bitwiseAND(63).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    found = words.toPandas()  # a row per 64 bits at most
    bitmap[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return digests.sparkSession.sparkContext.broadcast(bitmap)


def _in(bitmap: np.ndarray, digest: np.ndarray) -> np.ndarray:
    place = (digest.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bitmap[place >> 6] >> (place & 63)) & 1 == 1


def _strings(bits: int, wanted: Broadcast):
    """``digest, low, high`` of a task's texts: the smallest and largest string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[bytes, bytes]] = {}

        def out() -> pa.RecordBatch:
            ends = list(zip(*seen.values()))
            return pa.RecordBatch.from_arrays(
                [pa.array(seen, pa.int64()), *(pa.array(e, pa.binary()).cast(pa.string()) for e in ends)],
                ["digest", "low", "high"],
            )

        for _, _, texts in _batches(batches):
            terms = Terms(texts, bits)
            terms.keep(_in(wanted.value, terms.digest))
            for digest, string in terms.distinct():
                low, high = seen.get(digest, (string, string))
                if not low <= string <= high or digest not in seen:
                    seen[digest] = (min(low, string), max(high, string))
            if len(seen) >= STRINGS:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return run


def _exact_counts(bits: int, wanted: Broadcast):
    """``lang, source, digest, split, n, docs`` of a task's texts by string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, sources, texts in _batches(batches):
            terms = Terms(texts, bits)
            terms.keep(_in(wanted.value, terms.digest))
            found: dict[tuple, list] = {}
            for i, row in enumerate(terms.row):
                count = found.setdefault((langs[row], sources[row], int(terms.digest[i]), terms.string(i)), [0, 0, -1])
                count[0] += 1
                count[1] += count[2] != row
                count[2] = row
            if found:
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.string()),
                        pa.array(columns[1], pa.string()),
                        pa.array(columns[2], pa.int64()),
                        pa.array(columns[3], pa.binary()).cast(pa.string()),
                        *(pa.array([c[k] for c in found.values()], pa.int64()) for k in (0, 1)),
                    ],
                    ["lang", "source", "digest", "split", "n", "docs"],
                )

    return run


def _per_term(counts: DataFrame, min_docs: int, *keys: str) -> DataFrame:
    """The kept rows by ``keys``, each with the counts of its sources."""
    # Dealt out by the keys once: both sums are made where the rows of a key lie. A key
    # gets a row per task and source.
    by_source = counts.repartition(*keys).groupBy(*keys, "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    per_term = by_source.groupBy(*keys).agg(
        F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts")
    )
    return per_term.where(F.col("docs") >= min_docs).drop("docs")


def kept_terms(rows: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """``lang, digest, split, counts`` of the kept terms and ``digest, low`` with their
    strings; ``split`` is the string of a term whose digest stands for several, else ''."""
    bits = settings.digest_bits
    counted = rows.mapInArrow(_counts(bits), "lang string, source string, digest long, n long, docs long")
    kept = materialise(_per_term(counted, settings.min_docs, "lang", "digest"), "terms")
    digests = kept.select("digest").distinct()
    strings = rows.mapInArrow(_strings(bits, _wanted(digests)), "digest long, low string, high string")
    strings = strings.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    strings = materialise(strings.join(digests, "digest", "left_semi"), "strings")
    collided = strings.where("low <> high").select("digest")
    kept = kept.select("lang", "digest", F.lit("").alias("split"), "counts")
    if collided.isEmpty():
        return kept, strings
    exact = rows.mapInArrow(
        _exact_counts(bits, _wanted(collided)),
        "lang string, source string, digest long, split string, n long, docs long",
    ).join(collided, "digest", "left_semi")
    split = _per_term(exact, settings.min_docs, "lang", "digest", "split")
    whole = kept.join(collided, "digest", "left_anti")
    return materialise(whole.unionByName(split), "terms"), strings


def _share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (n + PLUS) / (total + PLUS * terms))``, exact."""
    wide = "decimal(20,0)"
    above = (n.cast(wide) + F.lit(PLUS).cast("decimal(1,0)")) * F.lit(UNIT).cast("decimal(10,0)")
    below = F.nullif(total.cast(wide) + terms.cast(wide) * F.lit(PLUS).cast("decimal(1,0)"), F.lit(0))
    return F.call_function("div", above, below) + 1


def _distances(rows: DataFrame) -> DataFrame:
    """``lang, a, b, value``: sums over ``rows(lang, tile, base, at, p)`` of how far the
    shares of sources a and b lie apart. ``base`` has the share of a term that a source
    lacks, for every source of the language, ``p`` those of the sources ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def out() -> pa.RecordBatch:
            a, b = np.nonzero(total)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0]] * len(a), pa.string()),
                    pa.array(a + key[1] * TILE, pa.int32()),
                    pa.array(b, pa.int32()),
                    pa.array(total[a, b], pa.int64()),
                ],
                ["lang", "a", "b", "value"],
            )

        for batch in batches:
            langs, tiles, bases, at, p = batch.columns
            keys = list(zip(langs.to_pylist(), tiles.to_pylist()))
            i = 0
            while i < len(keys):
                if keys[i] != key:
                    if key is not None:
                        yield out()
                    key, base = keys[i], np.array(bases[i].as_py(), dtype=np.int64)
                    total = np.zeros((len(base[key[1] * TILE :][:TILE]), len(base)), dtype=np.int64)
                j = i + 1
                most = max(1, CELLS // len(base))
                while j < len(keys) and j - i < most and keys[j] == key:
                    j += 1
                shares = np.repeat(base[None], j - i, axis=0)
                for k in range(i, j):
                    shares[k - i, at[k].values.to_numpy()] = p[k].values.to_numpy()
                for k in range(len(total)):
                    own = shares[:, key[1] * TILE + k, None]
                    total[k] += np.abs(shares - own).sum(axis=0)
                i = j
        if key is not None:
            yield out()

    sorted_rows = rows.select("lang", "tile", "base", "at", "p").sortWithinPartitions("lang", "tile")
    found = sorted_rows.mapInArrow(run, "lang string, a int, b int, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``lang, source, part, item, value, rank``: how the sources of each language differ.

    Uses ``text``, ``lang`` and ``source``; other columns, whatever their names, are left
    alone. Nulls of the three are read as ''. Terms are runs of ASCII letters and
    characters from U+0080, A-Z folded. A language keeps the terms in at least ``min_docs`` of its documents;
    a row is a document, equal rows are several. Shares of kept terms are
    ``1 + floor(10**9 * (count + 5) / (N + 5 * V))``. Part ``pair`` has every other source
    of the language with the sum of differences of shares; part ``term`` the kept terms of which the source
    has a larger share than the language, the ``top`` first ones. Ranks go by value, the
    larger first, then by item in UTF-8 order. A language without kept terms has pairs of
    value 0 alone, a language with one source has none. An empty table gives an empty
    result.
    """
    blank = F.lit("")
    lang, source = F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source")
    rows = docs.select(lang, source, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    terms, strings = kept_terms(rows, settings)

    per_source = terms.select("lang", "digest", "split", F.explode("counts").alias("c")).select(
        "lang", "digest", "split", "c.source", "c.n"
    )
    totals = per_source.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = docs.select(lang, source).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select(
        "lang",
        "source",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("terms", F.lit(0)).alias("terms"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"),
    )
    groups = groups.withColumn("base", _share(F.lit(0), F.col("total"), F.col("terms")))
    groups = materialise(groups, "groups")
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"),
        F.sort_array(F.collect_list(F.struct("place", "source", "base"))).alias("sources"),
    )
    langs = materialise(langs, "langs")

    n_lang = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    shares = terms.withColumn("n_lang", n_lang).join(langs.select("lang", "lang_total"), "lang")
    shares = shares.select("lang", "digest", "split", "n_lang", "lang_total", F.explode("counts").alias("c"))
    shares = shares.select("*", "c.source", "c.n").join(groups, ["lang", "source"])
    shares = shares.select(
        "lang", "source", "digest", "split", "place",
        _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("n_lang"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    shares = materialise(shares, "shares")

    tile = F.sequence(F.lit(0), F.floor((F.size("base") - 1) / TILE).cast("int"))
    vectors = (
        shares.groupBy("lang", "digest", "split")
        .agg(F.collect_list(F.struct("place", "p")).alias("known"))
        .join(langs.select("lang", F.col("sources.base").alias("base")), "lang")
        .select("lang", "base", F.col("known.place").alias("at"), F.col("known.p").alias("p"), F.explode(tile).alias("tile"))
    )
    sums = _distances(vectors)
    pairs = groups.select("lang", "source", F.col("place").alias("a")).join(langs.select("lang", "sources"), "lang")
    pairs = pairs.select("lang", "source", "a", F.explode("sources").alias("other"))
    pairs = pairs.select("lang", "source", "a", F.col("other.place").alias("b"), F.col("other.source").alias("item"))
    pairs = pairs.where("a <> b").join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    by_item = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    # Rows that tie with the last rank get their strings too, which then decide.
    top = shares.where("p > q").withColumn("value", F.col("p") - F.col("q"))
    top = top.withColumn("at", F.rank().over(by_value)).where(F.col("at") <= settings.top)
    named = top.join(strings.select("digest", "low"), "digest")
    item = F.when(F.col("split") == "", F.col("low")).otherwise(F.col("split"))
    named = named.select("lang", "source", F.lit("term").alias("part"), item.alias("item"), "value")
    named = named.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= settings.top)
    return named.unionByName(pairs.withColumn("rank", F.row_number().over(by_item)))
