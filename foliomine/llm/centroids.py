"""Centroid clustering over a vector-approximation file.

The vectors are integers. Beside each vector its row holds an approximation: per
component the number of a cell of few bits, packed. Cells are bounded by quantiles of
the component, so cells are about equally full; any bounds are right.

An assignment reads the approximations. Per centroid a lookup table has, for each
component and cell, the least and the greatest contribution to the distance, and their
sums bound the distance to that centroid from both sides. Contributions are measured
from the distance to a point that all centroids share (their mean), which leaves their
order as it is and takes away the part of a vector that they have in common. The
centroids whose interval overlaps that of the nearest are the candidates; where there is
just one, the vector itself is not looked at. Otherwise the exact distances to the
candidates decide.

Sums of clusters are kept from round to round: a round adds and takes away the vectors
that change their cluster. A vector's earlier cluster comes from the earlier centroids
by the same tables, so no assignment is stored, and nothing is shuffled but the sums of
each task. The driver holds centroids and sums, clusters times components numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliomine.llm.scratch import materialise

SCALE = 1024
LIMIT = 1 << 26  # of a component's integer: squared distances fit 64 bits
ROWS = 1024  # vectors that are looked up at once
RESULT = (
    "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
)


@dataclass(frozen=True)
class Settings:
    components: int = 64
    clusters: int = 8
    rounds: int = 10
    seed: int = 3
    bits: int = 6


def whole_vectors(embeddings: DataFrame, components: int) -> DataFrame:
    """``vec_id, vector``: the vectors of the wanted length without null or non-finite
    components, as integers."""
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    inside = F.forall(scaled, lambda x: F.abs(x) <= LIMIT)
    message = f"a component is beyond +-{LIMIT // SCALE}: squared distances would not fit 64 bits"
    return embeddings.where((F.size("embedding") == components) & finite).select(
        "vec_id", F.when(inside, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(message))).alias("vector")
    )


def cell_bounds(vectors: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray] | None:
    """First and last integer of each component's cells, over all vectors; None where
    there is no vector."""
    cells = 2**settings.bits
    shares = [i / cells for i in range(1, cells)]
    found = vectors.agg(
        *(
            F.struct(
                F.min(x := F.get("vector", F.lit(d))).alias("low"),
                F.max(x).alias("high"),
                F.percentile_approx(x, shares, 1000).alias("inner"),
            ).alias(f"d{d}")
            for d in range(settings.components)
        )
    ).first()
    if found["d0"]["low"] is None:
        return None
    first = np.array([[c["low"], *c["inner"]] for c in found], dtype=np.int64)
    last = np.array([[*(x - 1 for x in c["inner"]), c["high"]] for c in found], dtype=np.int64)
    return first, last


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components).astype(np.int64)


def pack(vectors: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """The cell numbers of each vector, ``bits`` bits each, as a row of bytes."""
    cells = np.empty(vectors.shape, dtype=np.uint8)
    for d in range(vectors.shape[1]):
        cells[:, d] = np.searchsorted(first[d, 1:], vectors[:, d], side="right")
    planes = (cells[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(len(vectors), -1), axis=1)


def unpack(packed: np.ndarray, components: int, bits: int) -> np.ndarray:
    planes = np.unpackbits(packed, axis=1)[:, : components * bits].reshape(-1, components, bits)
    return planes.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def lookup(centroids: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``[component * cells + cell, 2 * centroid + side]``: least and greatest
    contribution to the distance, less that to the mean of the centroids."""
    shared = np.floor_divide(centroids.sum(axis=0), len(centroids))[:, None]
    table = []
    for c in centroids[:, :, None]:
        # (x - c)^2 - (x - shared)^2 is linear in x, so a cell's ends bound it.
        ends = [(x - c) ** 2 - (x - shared) ** 2 for x in bounds]
        table += [np.minimum(*ends).ravel(), np.maximum(*ends).ravel()]
    return np.stack(table, axis=1)


def candidates(cells: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``[vector, centroid]``: whether the centroid may be the nearest one."""
    n, components = cells.shape
    place = cells + np.arange(components) * (len(table) // components)
    found = np.empty((n, table.shape[1] // 2), dtype=bool)
    for i in range(0, n, ROWS):
        sums = table[place[i : i + ROWS]].sum(axis=1)
        low, high = sums[:, ::2], sums[:, 1::2]
        found[i : i + ROWS] = low <= high.min(axis=1, keepdims=True)
    return found


def nearest(vectors: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid of its candidates;
    of equally near ones the smaller number."""
    cluster = np.empty(len(vectors), dtype=np.int64)
    distance = np.empty(len(vectors), dtype=np.int64)
    for i in range(0, len(vectors), ROWS):
        block = vectors[i : i + ROWS]
        d = np.full((len(block), len(centroids)), np.iinfo(np.int64).max)
        for k, c in enumerate(centroids):
            own = among[i : i + ROWS, k]
            d[own, k] = ((block[own] - c) ** 2).sum(axis=1)
        cluster[i : i + ROWS] = d.argmin(axis=1)
        distance[i : i + ROWS] = d.min(axis=1)
    return cluster, distance


def with_cells(vectors: DataFrame, first: np.ndarray, settings: Settings) -> DataFrame:
    """``vectors(vec_id, vector)`` with their packed ``cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pack(_matrix(batch.column("vector"), settings.components), first, settings.bits)
            cells = pa.array([row.tobytes() for row in packed], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), cells], ["vec_id", "vector", "cells"]
            )

    return vectors.mapInArrow(run, "vec_id long, vector array<int>, cells binary")


def _marks(sets: list[np.ndarray], bounds: tuple[np.ndarray, np.ndarray], settings: Settings):
    """A function of packed cells: per set of centroids the candidates, a byte each. It
    counts as not deterministic, so that Spark keeps one evaluation per row where a
    filter reads it too."""
    tables = [lookup(c, bounds) for c in sets]
    width = -(-settings.components * settings.bits // 8)

    @F.pandas_udf("array<binary>")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for packed in batches:
            rows = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(-1, width)
            cells = unpack(rows, settings.components, settings.bits)
            found = [candidates(cells, t) for t in tables]
            yield pd.Series([[f[i].tobytes() for f in found] for i in range(len(rows))])

    return marked.asNondeterministic()


def _sets(column: pa.Array, sets: int, n: int) -> np.ndarray:
    """``[set, vector, centroid]`` of the marks that :func:`_marks` made."""
    flat = np.frombuffer(b"".join(column.flatten().to_pylist()), dtype=bool)
    return flat.reshape(n, sets, -1).swapaxes(0, 1)


def _one(mark: Column) -> Column:
    """Whether just one byte of a mark is set."""
    return F.length(F.replace(F.hex(mark), F.lit("00"), F.lit(""))) == 2


def moves(table: DataFrame, before: np.ndarray | None, now: np.ndarray, bounds, settings: Settings) -> DataFrame:
    """``cluster, component, change``: what a round's assignment to the centroids
    ``now`` adds to the sums of the clusters under ``before``; component -1 is the count.
    Without ``before`` no vector is in a cluster yet."""
    sets = [now] if before is None else [now, before]
    marked = table.withColumn("marks", _marks(sets, bounds, settings)("cells"))
    if before is not None:
        new, old = F.get("marks", F.lit(0)), F.get("marks", F.lit(1))
        marked = marked.where(~(_one(new) & (new == old)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((settings.clusters, settings.components + 1), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"), settings.components)
            among = _sets(batch.column("marks"), len(sets), len(vectors))
            places = [nearest(vectors, c, a)[0] for c, a in zip(sets, among)]
            vectors = np.hstack([vectors, np.ones((len(vectors), 1), dtype=np.int64)])
            changed = places[0] != places[1] if len(sets) == 2 else np.ones(len(vectors), dtype=bool)
            for sign, place in zip((1, -1), places):
                for k in np.unique(place[changed]):
                    total[k] += sign * vectors[changed & (place == k)].sum(axis=0)
        cluster, component = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(cluster, pa.int32()),
                pa.array(np.where(component == settings.components, -1, component), pa.int32()),
                pa.array(total[cluster, component], pa.int64()),
            ],
            ["cluster", "component", "change"],
        )

    changes = marked.select("vector", "marks").mapInArrow(run, "cluster int, component int, change long")
    return changes.groupBy("cluster", "component").agg(F.sum("change").alias("change"))


def cluster_vectors(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``, a row per
    vector of the wanted length whose components are neither null nor non-finite.

    Uses ``vec_id`` and ``embedding`` (an array of floats or doubles); other columns,
    whatever their names, are left alone. Vectors that are null, of another length or hold
    a null, NaN or infinity give no row. The first centroids are the vectors with the
    smallest hash of their id; among rows of one id the smaller vector comes first, and a
    null id counts as an empty one. Equal rows get equal results, each counts. With
    fewer vectors than clusters there are as many clusters as vectors. Of equally near centroids the
    smaller number wins. A cluster without vectors keeps its centroid. An empty table
    gives an empty result. A component of 65,536 and more (its squares would not fit a
    long) is an error.
    """
    spark = embeddings.sparkSession
    source = whole_vectors(embeddings, settings.components)
    bounds = cell_bounds(source, settings)
    if bounds is None:
        return spark.createDataFrame([], RESULT)
    table = materialise(with_cells(source, bounds[0], settings), "cells")
    name = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    starts = table.orderBy(F.sha2(name, 256), "vector").limit(settings.clusters).select("vector").collect()
    now = np.array([r["vector"] for r in starts], dtype=np.int64)
    before = None
    totals = np.zeros((settings.clusters, settings.components + 1), dtype=np.int64)
    for _ in range(settings.rounds):
        if before is not None and np.array_equal(before, now):
            break  # the same centroids: every further round repeats this one
        for r in moves(table, before, now, bounds, settings).collect():  # clusters x components
            totals[r["cluster"], r["component"]] += r["change"]
        before = now
        count = totals[: len(now), -1:]
        means = np.floor_divide(totals[: len(now), :-1], np.maximum(count, 1))
        now = np.where(count > 0, means, now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), settings.components)
            among = _sets(batch.column("marks"), 1, len(vectors))[0] if len(vectors) else np.empty((0, 0))
            cluster, distance = nearest(vectors, now, among)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                ["vec_id", "cluster", "distance"],
            )

    marked = table.withColumn("marks", _marks([now], bounds, settings)("cells"))
    assigned = marked.select("vec_id", "vector", "marks").mapInArrow(
        run, "vec_id long, cluster int, distance long"
    )
    assigned = materialise(assigned, "assigned")
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in now]
    per_cluster = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    inertia = sum(r["cluster_inertia"] for r in per_cluster)
    facts = [(r["cluster"], r["cluster_inertia"], inertia, digests[r["cluster"]]) for r in per_cluster]
    known = spark.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    # A row per cluster.
    joined = assigned.join(F.broadcast(known), "cluster")
    return joined.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
