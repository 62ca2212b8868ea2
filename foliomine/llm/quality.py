"""Quality classifier: logistic regression on hashed word n-grams.

A text becomes a sparse vector: its tokens (runs of letters, digits and non-ASCII
bytes, or runs of other signs) and pairs of neighbouring tokens, hashed to
``2 ** bits`` places, damped counts scaled to length one. A pair of equal tokens is
the same feature whatever the token. The model is a weight
per place, trained with follow-the-regularised-leader updates, one document at a
time, on a bounded sample of labelled documents; a score is the sigmoid of a sparse
dot product. Labels, languages, sources and ids are no features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliomine.llm.words import as_bytes, mix, range_hashes

_KIND = np.full(256, 2, dtype=np.int8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[ord("0") : ord("9") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[0x80:] = 1
_TWICE = np.uint64(0x5BD1E9955BD1E995)


@dataclass(frozen=True)
class Settings:
    """Settings of a model. ``max_train`` bounds the sample that is trained on."""

    bits: int = 18
    max_train: int = 8192
    epochs: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3


def features(text: str | bytes | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's vector, both empty for a text without tokens."""
    data = as_bytes(text, lower=True)
    kind = np.zeros(len(data) + 2, dtype=np.int8)
    kind[1:-1] = _KIND[data]
    change = np.flatnonzero(np.diff(kind))
    if not len(change):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    first, past = change[:-1], change[1:]
    token = kind[first + 1] > 0
    words = range_hashes(data, first[token], past[token])
    with np.errstate(over="ignore"):
        pairs = mix(words[:-1] * np.uint64(3) + words[1:], 2)
        pairs[words[:-1] == words[1:]] = _TWICE
    hashed = np.concatenate([mix(words, 1), pairs]) >> np.uint64(64 - bits)
    places, counts = np.unique(hashed, return_counts=True)
    values = np.log1p(counts)
    return places.astype(np.int64), values / np.sqrt(np.dot(values, values))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal over the examples, in their
    order; the last weight is that of a constant feature. All zeros for no example."""
    size = 2**settings.bits + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights_at(at: np.ndarray) -> np.ndarray:
        kept = np.abs(z[at]) > settings.l1
        rate = (settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2
        return np.where(kept, -(z[at] - np.sign(z[at]) * settings.l1) / rate, 0.0)

    for _ in range(settings.epochs):
        for places, values, label in examples:
            at, x = np.append(places, size - 1), np.append(values, 1.0)
            w = weights_at(at)
            p = 1 / (1 + np.exp(-np.clip(np.dot(w, x), -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights_at(np.arange(size)).astype(np.float32)


def score(weights: np.ndarray, places: np.ndarray, values: np.ndarray) -> float:
    total = float(weights[-1]) + float(np.dot(weights[places].astype(np.float64), values))
    return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights learned from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    At most ``max_train`` labelled documents are used, those whose doc_id has the
    smallest hash; the order of training is the order of the hash. Equal rows count
    once, of labels and of documents. They meet in one task, which holds no more than
    this bound. Rows without doc_id, text or label are left out. Without any example all weights are zero, so every score is 0.5.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .select("doc_id", F.col("quality").cast("int").alias("quality"))
        .distinct()
        .withColumn("place", F.xxhash64("doc_id"))
        .orderBy("place", "doc_id", "quality")
        .limit(settings.max_train)
    )
    rows = docs.where("doc_id is not null and text is not null").select(
        "doc_id", F.col("text").cast("binary").alias("text")
    )
    keys = ["place", "doc_id", "quality", "text_hash"]
    sample = (
        rows.join(chosen, "doc_id")
        .groupBy("place", "doc_id", "quality", F.sha2("text", 256).alias("text_hash"))
        .agg(F.any_value("text").alias("text"))
        .orderBy(*keys)
        .limit(settings.max_train)
        .withColumn("all", F.lit(1))
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "doc_id", "quality", "text"])
        examples = [(*features(t, settings.bits), int(q)) for t, q in zip(group["text"], group["quality"])]
        return pd.DataFrame({"weights": [train(examples, settings).tobytes()]})

    found = sample.groupBy("all").applyInPandas(run, "weights binary").collect()
    if not found:
        return np.zeros(2**settings.bits + 1, dtype=np.float32)
    return np.frombuffer(found[0]["weights"], dtype=np.float32)


def with_score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with the score of its whole ``text`` in a further column, from 0 to 1.
    A null or empty text is scored by the constant weight alone."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** bits floats
    bits = (len(weights) - 1).bit_length() - 1

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([score(model.value, *features(t, bits)) for t in batch], dtype="float64")

    return docs.withColumn(column, scored(F.col("text").cast("binary")))


def score_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row per row of ``docs``.

    Documents with crc32 of the doc_id's digits divisible by 5 are held out of
    training. A document without doc_id is no training row and not held out. A null text
    scores as an empty one, by the constant weight alone. Equal texts have equal scores,
    a score of just 0.3 is predicted 1. Without a usable label every score is 0.5; an empty table gives
    an empty result.
    """
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    weights = fit(docs, labels.where(~held_out), settings)
    scored = with_score(docs.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def keep_quality(
    docs: DataFrame, labels: DataFrame, least: float = 0.3, settings: Settings = Settings()
) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more under a model of
    the labelled documents that are not held out. Texts,
    repeated rows and empty tables are as in :func:`score_quality`; columns may have any names."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    scored = with_score(docs.select(whole, "text"), fit(docs, labels.where(~held_out), settings))
    return scored.where(F.col("score") >= least).select("row.*")
