"""Near-duplicate documents by one-permutation MinHash.

1. Per document, inside its row: the set of its word shingles, one-permutation
   minima of that set over ``bands * rows`` bins, empty bins filled by optimal
   densification, and one key per band.
2. Documents with equal sets become one class, the smallest doc_id its node, so
   a group of copies moves as one row from then on.
3. Classes with a band key in common are candidates. Each bucket contributes a
   star: an edge from its smallest node to every other one, never all pairs.
4. The edges are confirmed on the full sets of the two texts: those of the first
   bands before the others, of which only edges between different components of
   links found so far are left to confirm.
5. A star leaves out pairs of two leaves. Buckets that still hold nodes of several
   components are therefore searched exactly: every node outside the bucket's
   largest component against the whole bucket, in blocks of bounded size that give
   back links alone. Buckets that one component dominates are searched as one, and
   so are buckets of the same nodes.
6. Components of all links.

No bucket or partner list is capped. What may be missed is a pair at the
threshold that shares no band key; the bands are chosen so that this has a chance
below ``MISS``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliomine.llm.components import components
from foliomine.llm.scratch import materialise
from foliomine.llm.words import mix, shingle_set

MISS = 1e-10
MAX_BANDS = 48
FIRST_BANDS = 6  # bands whose stars are confirmed before those of the others
BLOCK = 256  # texts on either side of a block
SLAB = 4096  # shingles of a block that are compared at once


def band_layout(threshold: float) -> tuple[int, int]:
    """``(bands, rows)``: the most rows a band can have while a pair at the
    threshold still goes without a common band with a chance below ``MISS``."""
    layout = (0, 0)
    for rows in range(1, 33):
        agree = threshold**rows
        bands = 1 if agree >= 1 else math.ceil(math.log(MISS) / math.log1p(-agree))
        if rows > 1 and bands > MAX_BANDS:
            break
        layout = (bands, rows)
    return layout


@lru_cache(maxsize=8)
def _donors(bins: int) -> np.ndarray:
    """For each bin, all bins in a fixed random order with itself first: an empty
    bin takes the minimum of the first bin in its order that is not empty."""
    order = np.random.RandomState(bins).rand(bins, bins)
    order[np.arange(bins), np.arange(bins)] = -1
    return np.argsort(order, axis=1)


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band of a non-empty sorted set of 64-bit hashes."""
    bins = bands * rows
    place = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    filled, first = np.unique(place, return_index=True)  # sorted, so the first is the minimum
    minima = np.zeros(bins, dtype=np.uint64)
    minima[filled] = shingles[first]
    if len(filled) < bins:
        full = np.zeros(bins, dtype=bool)
        full[filled] = True
        order = _donors(bins)
        minima = minima[order[np.arange(bins), np.argmax(full[order], axis=1)]]
    keys = np.arange(bands, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            keys = mix(keys + minima[k::rows], k)
    return keys.view(np.int64)


def _features(n: int, bands: int, rows: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_shingles", pa.int64()),
            ("set_key", pa.binary()),
            ("bands", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, found = [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), n)
                sizes.append(len(shingles))
                if len(shingles):
                    keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    found.append(band_keys(shingles, bands, rows))
                else:
                    keys.append(None)
                    found.append(None)
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(found, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _links_in_block(n: int, percent: int):
    """Links between the ``query`` rows of a block and its other rows.

    Every pair of the block is compared, and what it links is given back as a forest:
    one row for each component that is linked with a smaller one. So a block gives
    back fewer rows than it has texts, however many pairs of it are linked.
    """

    def run(block: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, n) for t in block["text"]]
        query = block["query"].to_numpy()
        left, right = np.flatnonzero(query), np.flatnonzero(~query)
        sizes = np.array([len(s) for s in sets])
        common = np.zeros((len(left), len(right)), dtype=np.int64)
        if len(left) and len(right):
            ours = np.unique(np.concatenate([sets[i] for i in left]))
            theirs = np.unique(np.concatenate([sets[i] for i in right]))
            shared = np.intersect1d(ours, theirs, assume_unique=True)

            def places(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                row = np.repeat(np.arange(len(side)), sizes[side])
                all_of = np.concatenate([sets[i] for i in side])
                at = np.minimum(np.searchsorted(shared, all_of), max(len(shared) - 1, 0))
                known = shared[at] == all_of if len(shared) else np.zeros(len(all_of), dtype=bool)
                return row[known], at[known]

            rows_l, at_l = places(left)
            rows_r, at_r = places(right)
            for start in range(0, len(shared), SLAB):
                stop = min(start + SLAB, len(shared))
                matrices = []
                for rows, at, height in ((rows_l, at_l, len(left)), (rows_r, at_r, len(right))):
                    held = (at >= start) & (at < stop)
                    dense = np.zeros((height, stop - start), dtype=np.float32)
                    dense[rows[held], at[held] - start] = 1
                    matrices.append(dense)
                common += np.rint(matrices[0] @ matrices[1].T).astype(np.int64)
        union = sizes[left][:, None] + sizes[right][None, :] - common
        i, j = np.nonzero((100 * common >= percent * union) & (union > 0))
        names, place = np.unique(block["component"].to_numpy(), return_inverse=True)
        ends = np.unique(np.stack([place[left[i]], place[right[j]]]), axis=1)
        root = np.arange(len(names))
        while True:
            lower = root.copy()
            least = np.minimum(root[ends[0]], root[ends[1]])
            for end in ends:
                np.minimum.at(lower, end, least)
            lower = lower[lower]
            if np.array_equal(lower, root):
                break
            root = lower
        tied = root != np.arange(len(names))
        return pd.DataFrame({"a": names[tied], "b": names[root[tied]]})

    return run


def _links(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` of components inside the blocks of ``members(block, part, other,
    query, node, component)``."""
    keys = ["block", "part", "other"]
    rows = members.hint("merge").join(texts, "node")
    run = _links_in_block(n, percent)
    return rows.groupBy(*keys).applyInPandas(run, "a long, b long")


def _chunks(count: str):
    """A node's chunk of a side that holds ``count`` nodes, ``BLOCK`` each on average."""
    return F.pmod(F.xxhash64("node"), F.ceil(F.col(count) / BLOCK).cast("long"))


def _star_links(stars: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links of the edges ``stars(centre, node, centre_label, label)``, as links of labels."""
    per_centre = stars.groupBy("centre").agg(F.count("*").alias("size"))
    leaves = stars.join(per_centre, "centre").select(
        F.col("centre").alias("block"),
        _chunks("size").alias("part"),
        F.lit(0).cast("long").alias("other"),
        F.lit(False).alias("query"),
        "node",
        F.col("label").alias("component"),
        "centre_label",
    )
    hubs = leaves.select(
        "block", "part", "other", F.lit(True).alias("query"), F.col("block").alias("node"),
        F.col("centre_label").alias("component"),
    ).distinct()
    return _links(leaves.drop("centre_label").union(hubs), texts, n, percent)


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the component of ``node`` as ``label``; a node without links is its own."""
    labels = found.select("node", F.col("component").alias("label"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _contracted(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found(node, component)`` joined by ``links`` between them."""
    merged = materialise(components(links), "merged")
    renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
    old = found.join(renamed, "component", "left").select(
        "node", F.coalesce("root", "component").alias("component")
    )
    # Components of one node are no rows of ``found``.
    return materialise(old.union(merged.join(found, "node", "left_anti")), "components")


def _torn_buckets(members: DataFrame) -> DataFrame:
    """``(block, node, label, query)``: the nodes of the buckets ``members(bucket, node, label)``
    that hold several labels; ``query`` marks those outside the bucket's largest label.

    A bucket with a label of several nodes goes to the block of that label, any other one to
    the block of its set of nodes."""
    print_of = F.expr("bit_xor(xxhash64(node))")
    per_label = members.groupBy("bucket", "label").agg(
        F.count("*").alias("size"), print_of.alias("print"), F.min("node").alias("least")
    )
    torn = (
        per_label.groupBy("bucket")
        .agg(
            F.count("*").alias("labels"),
            F.max(F.struct("size", F.col("label").alias("owner"))).alias("largest"),
            F.expr("bit_xor(print)").alias("print"),
            F.min("least").alias("least"),
        )
        .where("labels > 1")
        .select(
            "bucket",
            F.col("largest.owner").alias("owner"),
            F.when(F.col("largest.size") > 1, F.concat_ws(":", F.lit("label"), "largest.owner"))
            .otherwise(F.concat_ws(":", F.lit("nodes"), "labels", "least", "print"))
            .alias("block"),
        )
    )
    rows = members.join(torn, "bucket").select("block", "node", "label", F.col("label") != F.col("owner"))
    return rows.toDF("block", "node", "label", "query").groupBy("block", "node", "label").agg(
        F.max("query").alias("query")
    )


def _search_blocks(torn: DataFrame) -> DataFrame:
    """Rows of :func:`_links` that compare the queries of each block of ``torn`` with all its nodes."""
    sizes = torn.groupBy("block").agg(
        F.count("*").alias("n_all"), F.sum(F.col("query").cast("long")).alias("n_query")
    )
    rows = torn.withColumnRenamed("label", "component").join(sizes, "block")

    def copies(count: str):
        last = F.ceil(F.col(count) / BLOCK).cast("long") - 1
        return F.explode(F.sequence(F.lit(0).cast("long"), last))

    queries = rows.where("query").select(
        "block", _chunks("n_query").alias("part"), copies("n_all").alias("other"),
        F.lit(True).alias("query"), "node", "component",
    )
    against = rows.select(
        "block", copies("n_query").alias("part"), _chunks("n_all").alias("other"),
        F.lit(False).alias("query"), "node", "component",
    )
    return queries.union(against)


def link_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Columns ``doc_id, n_shingles, component_id, kept``, a row per row of ``docs``.

    Uses ``doc_id`` and ``text`` of ``docs``; other columns, whatever their names,
    are left alone. Texts have A-Z folded and are split at ASCII white space; a
    document's set is its distinct ``n``-word shingles, or its whole word sequence
    if it has fewer words. Two documents are linked if the intersection of their
    sets is at least ``percent`` per cent of the union. ``component_id`` is the
    smallest doc_id that links reach, ``kept`` marks the row of that doc_id.

    A null text, an empty text and a text of white space have an empty set and are
    linked with nothing. Rows without doc_id are linked with nothing, have a null
    component and are kept. Equal rows get equal results. Rows of one doc_id with
    different texts count as one document, linked by either text, where the
    doc_id is the smallest of both. An empty table gives an empty result.
    """
    bands, rows = band_layout(percent / 100)
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>"
    features = materialise(source.mapInArrow(_features(n, bands, rows), schema), "features")
    classes = materialise(
        features.where("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("node"),
            F.max("n_shingles").alias("n"),
            F.any_value("bands").alias("bands"),
        ),
        "classes",
    )

    buckets = classes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    centres = (
        buckets.groupBy("bucket")
        .agg(F.min(F.struct("node", "n")).alias("centre"), F.count("*").alias("size"))
        .where("size > 1")
        .select("bucket", F.col("centre.node").alias("centre"), F.col("centre.n").alias("centre_n"))
    )
    near = F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * percent
    shared = buckets.join(centres, "bucket").select("bucket", "band", "node", "centre", near.alias("near"))
    shared = materialise(shared, "buckets")
    # The texts of candidates are dealt out by node once; all confirmations read
    # them. The hint keeps to one plan at every size: a list of candidates grows with
    # the documents and is no broadcast.
    nodes = shared.select("node").distinct()
    texts = source.withColumnRenamed("doc_id", "node").hint("merge").join(nodes, "node")
    # Repeated rows of a document are one text, so that a block holds each once.
    texts = texts.groupBy("node", F.md5("text").alias("text_md5")).agg(F.any_value("text").alias("text"))
    texts = materialise(texts.select("node", "text"), "texts")

    stars = shared.where("near and node <> centre")
    first = stars.where(F.col("band") < FIRST_BANDS).select("centre", "node").distinct()
    first = first.select("centre", "node", F.col("node").alias("label"), F.col("centre").alias("centre_label"))
    found = components(materialise(_star_links(first, texts, n, percent), "links"))

    apart = _labelled(stars.select("centre", "node"), found)
    centre_labels = found.select(F.col("node").alias("centre"), F.col("component").alias("centre_label"))
    apart = apart.join(centre_labels, "centre", "left").withColumn(
        "centre_label", F.coalesce("centre_label", "centre")
    )
    apart = apart.where("label <> centre_label").distinct()
    found = _contracted(found, materialise(_star_links(apart, texts, n, percent), "links"))

    torn = _torn_buckets(_labelled(shared.select("bucket", "node"), found))
    more = _links(_search_blocks(materialise(torn, "torn")), texts, n, percent)
    final = _contracted(found, materialise(more, "links"))

    named = classes.select("set_key", "node").join(final, "node", "left")
    named = named.select("set_key", F.coalesce("component", "node").alias("component_id"))
    alone = F.col("doc_id")
    return (
        features.drop("bands")
        .join(named, "set_key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(alone.isNotNull(), F.coalesce("component_id", alone)).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, all
    columns as they are. Equal rows of a kept document stay one row each; see
    :func:`link_documents` for nulls and empty texts."""
    dropped = link_documents(docs, n, percent).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
