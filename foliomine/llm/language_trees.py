"""Language identification by prediction by partial matching.

Per language a context tree of bytes: for every context of up to ``DEPTH`` bytes how
often which byte followed it in the training texts. The code length of a byte is
that of its longest known context: with count c of the byte, total T and D distinct
bytes the probability is c / (T + D), and with D / (T + D) the coder escapes to the
context one byte shorter, last to a uniform byte. Statistics are frozen after
training. The language with the shortest code for the whole text wins.

Only the counts travel. A task expands them once into a table with a row per known
context and a column per byte, so that scoring a text is two gathers per byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from foliomine.llm.quality import remainder
from foliomine.llm.words import as_bytes

DEPTH = 3
DOCS_PER_LANGUAGE = 400
UNDETERMINED = "und"
_HASHES = 1 << 40
_START = b"\n" * DEPTH  # stands before every text


def _text_bytes(text: str | bytes | None) -> np.ndarray:
    return as_bytes(text, lower=True)


def gram_counts(text: str | bytes | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte runs of length ``size`` that end inside the text, as big-endian
    numbers, with their counts."""
    data = _text_bytes(_START[: size - 1] + (text or b""))
    n = len(data) - size + 1
    codes = np.zeros(max(n, 0), dtype=np.int64)
    for k in range(size):
        codes = (codes << 8) | data[k : k + len(codes)]
    return np.unique(codes, return_counts=True)


class Model:
    """Code lengths in bits, ``costs[context, byte, language]``.

    ``grams`` maps ``(language, size)`` to codes and counts of byte runs.
    """

    def __init__(self, languages: list[str], grams: dict):
        self.languages = languages
        n_lang = len(languages)
        known = [np.unique(np.concatenate([grams[g, s][0] for g in languages])) for s in range(1, DEPTH + 2)]
        self.symbols = np.zeros(256, dtype=np.int64)  # 0: a byte that training never saw
        alphabet = np.union1d(known[0], list(_START))
        self.symbols[alphabet] = np.arange(1, len(alphabet) + 1)
        width = len(alphabet) + 1
        self.width = width
        # The root: order 0, escaping to a uniform byte.
        lower = np.zeros((1, width, n_lang))
        for j, language in enumerate(languages):
            codes, counts = grams[language, 1]
            total, distinct = counts.sum(), len(codes)
            lower[0, :, j] = np.log2((total + distinct) / max(distinct, 1)) + 8
            lower[0, self.symbols[codes], j] = np.log2((total + distinct) / counts)
        tables, offset = [lower], 1
        contexts = np.zeros(1, dtype=np.int64)
        places = []  # per depth: sorted contexts and their nodes
        for depth in range(1, DEPTH + 1):
            own = np.unique(known[depth] >> 8)  # contexts with a byte behind them
            shorter = own & ((1 << (8 * (depth - 1))) - 1)
            parent = np.searchsorted(contexts, shorter)
            # Every suffix of a known context is known too, as the texts start alike.
            table = tables[-1][parent].copy()
            for j, language in enumerate(languages):
                codes, counts = grams[language, depth + 1]
                at = np.searchsorted(own, codes >> 8)
                total = np.bincount(at, weights=counts, minlength=len(own))
                distinct = np.bincount(at, minlength=len(own))
                seen = distinct > 0
                table[seen, :, j] += np.log2((total + distinct)[seen] / distinct[seen])[:, None]
                table[at, self.symbols[codes & 255], j] = np.log2((total + distinct)[at] / counts)
            tables.append(table)
            places.append((own, np.arange(offset, offset + len(own))))
            contexts, offset = own, offset + len(own)
        self.costs = np.concatenate(tables).astype(np.float32).reshape(-1, n_lang)
        # Node of the longest known suffix for each run of DEPTH symbols.
        node = np.zeros((width,) * DEPTH, dtype=np.int32)
        for depth, (own, nodes) in enumerate(places, start=1):
            at = [self.symbols[(own >> (8 * (depth - 1 - k))) & 255] for k in range(depth)]
            node[(..., *at)] = nodes
        self.node = node.reshape(-1)

    def code_lengths(self, text: str | bytes | None) -> np.ndarray:
        """Bits of the whole text in each language."""
        data = _text_bytes(_START + (text or b""))
        symbols = self.symbols[data]
        n = len(data) - DEPTH
        if n <= 0:
            return np.zeros(len(self.languages))
        context = np.zeros(n, dtype=np.int64)
        for k in range(DEPTH):
            context = context * self.width + symbols[k : k + n]
        rows = self.node[context].astype(np.int64) * self.width + symbols[DEPTH:]
        return self.costs[rows].sum(axis=0, dtype=np.float64)

    def predict(self, text: str | bytes | None) -> tuple[str, float]:
        """The language of the shortest code, of equal ones the first by name, and its
        share of the probability of all languages."""
        bits = self.code_lengths(text)
        best = int(np.argmin(bits))
        return self.languages[best], float(1 / np.exp2(np.minimum(bits[best] - bits, 0)).sum())


def training_sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """``lang, text`` of at most ``per_language`` documents a language, those whose
    doc_id has the smallest hash, out of the documents with crc32 of the doc_id's
    digits not 2 modulo 4. Equal rows count once. Rows without doc_id, text or lang are
    left out."""
    usable = docs.where("doc_id is not null and lang is not null and text is not null")
    usable = usable.where(remainder(F.col("doc_id"), 4) != 2).select("doc_id", "lang", "text")
    # A row per language, of which the model holds a table each. Twice the wanted number
    # of ids is let through by the hash, so few rows meet to be ranked, however many there
    # are. The count of ids may be some per cent off.
    ids = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n"))
    shares = {r["lang"]: 2 * per_language / r["n"] for r in ids.collect()}
    if not shares:
        return usable.select("lang", "text")
    share = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col("lang")]
    place = F.xxhash64("doc_id")
    let_in = F.pmod(place, F.lit(_HASHES)) < share * _HASHES
    by_hash = Window.partitionBy("lang").orderBy(F.pmod(place, F.lit(_HASHES)), "doc_id", "text")
    distinct = (
        usable.where(let_in)
        .groupBy("lang", "doc_id", F.sha2("text", 256).alias("text_hash"))
        .agg(F.any_value("text").alias("text"))
    )
    ranked = distinct.withColumn("place", F.row_number().over(by_hash))
    return ranked.where(F.col("place") <= per_language).select("lang", "text")


def count_grams(sample: DataFrame) -> DataFrame:
    """``lang, size, code, n``: byte runs of ``sample(lang, text)`` of each size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for size in range(1, DEPTH + 2):
                    found = [gram_counts(bytes(t), size) for t in texts]
                    codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([k for _, k in found])).astype(np.int64)
                    yield pd.DataFrame({"lang": lang, "size": size, "code": codes, "n": n})

    rows = sample.select("lang", F.col("text").cast("binary").alias("text"))
    counted = rows.mapInPandas(run, "lang string, size int, code long, n long")
    return counted.groupBy("lang", "size", "code").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> dict | None:
    """The frozen counts by language and size; None if there is nothing to learn from.

    What comes to the driver are the counts of a sample of bounded size.
    """
    counts = count_grams(training_sample(docs, per_language)).toPandas()
    if not len(counts):
        return None
    counts = counts.sort_values(["lang", "size", "code"])
    grams = {
        (lang, size): (g["code"].to_numpy(np.int64), g["n"].to_numpy(np.int64))
        for (lang, size), g in counts.groupby(["lang", "size"])
    }
    languages = sorted({lang for lang, size in grams if (lang, DEPTH + 1) in grams})
    return {"key": uuid.uuid4().hex, "languages": languages, "grams": grams}


_expanded: dict[str, Model] = {}


def _model_of(frozen: dict) -> Model:
    """The expanded tables, made once per Python worker."""
    if frozen["key"] not in _expanded:
        _expanded.clear()
        _expanded[frozen["key"]] = Model(frozen["languages"], frozen["grams"])
    return _expanded[frozen["key"]]


def identify(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, a row per row of ``docs``.

    Learns from ``text`` and ``lang`` of the rows that are not held out and predicts
    from ``text`` alone. A null text and a text without any letter, and every text if
    there was nothing to learn from, are ``und`` with score 0. A row without doc_id
    is no training row and not held out.
    """
    spark = docs.sparkSession
    frozen = fit(docs, per_language)
    shared = spark.sparkContext.broadcast(frozen)

    @F.pandas_udf("struct<lang_pred string, score double>")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model_of(shared.value) if shared.value else None
        for batch in texts:
            rows = [
                model.predict(t.encode("utf-8", "surrogatepass"))
                if model and t and any(map(str.isalpha, t))
                else (UNDETERMINED, 0.0)
                for t in batch
            ]
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    rows = docs.select("doc_id", held_out, predicted("text").alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")
