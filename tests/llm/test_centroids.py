import hashlib
import math
import random

import numpy as np
import pytest

from foliomine.llm import centroids as ce

SMALL = ce.Settings(components=6, clusters=4, rounds=5, bits=3)


def brute(rows, settings):
    """Sorted result rows by comparing every vector with every centroid."""
    kept = []
    for i, e in rows:
        if e is None or len(e) != settings.components:
            continue
        if any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((i, [math.floor(x * 1024) for x in e]))
    name = lambda i: hashlib.sha256(f"{settings.seed}:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[: settings.clusters]]

    def assign():
        found = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            found.append((d.index(min(d)), min(d)))
        return found

    for _ in range(settings.rounds):
        found = assign()
        for k in range(len(centres)):
            own = [v for (_, v), (c, _) in zip(kept, found) if c == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    out = []
    for (i, _), (k, d) in zip(kept, found):
        digest = hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()
        out.append((i, k, d, sum(x for c, x in found if c == k), sum(x for _, x in found), digest))
    return sorted(out, key=repr)


def found(spark, rows, settings, kind="float"):
    docs = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return sorted((tuple(r) for r in ce.cluster_vectors(docs, settings).collect()), key=repr)


def clouds(n, seed, kind=float):
    rng = random.Random(seed)
    centres = [[rng.choice([-0.5, 0, 0.5]) for _ in range(6)] for _ in range(5)]
    return [(i, [float(np.float32(rng.gauss(x, 0.2))) for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_rounds(spark, seed):
    rows = clouds(300, seed)
    rows += [(i, [0.25] * 6) for i in range(1000, 1040)]  # a group of equal vectors
    assert found(spark, rows, SMALL) == brute(rows, SMALL)


@pytest.mark.parametrize("bits", [1, 5, 8])
def test_cells_of_any_width_give_the_same_rows(spark, bits):
    rows = clouds(120, 7)
    settings = ce.Settings(components=6, clusters=4, rounds=5, bits=bits)
    assert found(spark, rows, settings, "double") == brute(rows, settings)


def test_ties_empty_clusters_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 2)] * 6) for i in range(8)]  # two points: ties, two clusters stay empty
    rows += [(3, [1.0] * 6), (3, [1.0] * 6), (None, [0.5] * 6)]
    odd = [(90, None), (91, []), (92, [1.0] * 5), (93, [1.0] * 5 + [None]), (94, [nan] * 6), (95, [-inf] * 6)]
    got = found(spark, rows + odd, SMALL)
    assert got == brute(rows, SMALL) and len(got) == 11
    assert found(spark, odd, SMALL) == []
    two = [(1, [0.5] * 6), (2, [-0.5] * 6)]
    assert found(spark, two, SMALL) == brute(two, SMALL)


def test_columns_with_clashing_names(spark):
    rows = [(i, e, 5, b"x", i) for i, e in clouds(20, 3)]
    schema = "vec_id long, embedding array<float>, cluster int, cells binary, vector long"
    got = ce.cluster_vectors(spark.createDataFrame(rows, schema), SMALL)
    assert got.columns == [c.split()[0] for c in ce.RESULT.split(", ")] and got.count() == 20


def test_components_out_of_range_are_an_error(spark):
    with pytest.raises(Exception, match="fit 64 bits"):
        found(spark, [(1, [1e9] * 6)], SMALL, "double")


def test_intervals_hold_the_distance():
    rng = np.random.RandomState(4)
    vectors = rng.randint(-600, 600, size=(500, 6))
    inner = np.sort(rng.randint(-500, 500, size=(6, 7)), axis=1)
    first = np.hstack([vectors.min(axis=0)[:, None], inner])
    last = np.hstack([inner - 1, vectors.max(axis=0)[:, None]])
    packed = ce.pack(vectors, first, 3)
    assert packed.shape == (500, 3)  # six components of three bits
    cells = ce.unpack(packed, 6, 3)
    centres = rng.randint(-600, 600, size=(4, 6))
    table = ce.lookup(centres, (first, last))
    shared = np.floor_divide(centres.sum(axis=0), 4)
    sums = table[cells + np.arange(6) * 8].sum(axis=1)
    exact = ((vectors[:, None] - centres) ** 2).sum(axis=2) - ((vectors - shared) ** 2).sum(axis=1)[:, None]
    assert (sums[:, ::2] <= exact).all() and (exact <= sums[:, 1::2]).all()
    among = ce.candidates(cells, table)
    assert among[np.arange(500), exact.argmin(axis=1)].all() and 1 <= among.sum(axis=1).min() < 4


def test_supplied_vectors(spark, table):
    rows = [(r["vec_id"], r["embedding"]) for r in table("embeddings").collect()]
    got = ce.cluster_vectors(table("embeddings"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, ce.Settings())
