import random
import re

import numpy as np
import pytest

from foliomine.llm import near_duplicates as nd
from foliomine.llm.components import components
from foliomine.llm.words import shingle_set


def brute(rows, n, percent):
    """``doc_id -> (n_shingles, component_id, kept)`` by comparing all pairs."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        k = min(n, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def found(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect()}


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, n, percent):
    rng, rows = random.Random(n), []
    for group in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(25):
            rows.append(edited(rng, base, rng.randrange(0, max(2, len(base) // 12))))
    rows += rows[:5] + ["", None, " ", "one", "One", "two words", "TWO words"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.link_documents(docs, n, percent)) == brute(rows, n, percent)


def test_chain_of_links_is_one_component(spark):
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(8):  # each differs from the one before by a few words
        rows.append((100 - i, " ".join([f"x{k}" for k in range(2 * i)] + words[2 * i :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, 3, 85)
    assert {c for _, c, _ in expected.values()} == {93}
    assert found(nd.link_documents(docs, 3, 85)) == expected


def test_odd_rows(documents, none):
    got = nd.link_documents(documents, 3, 85).collect()
    assert len(got) == documents.count()
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["n_shingles"] for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1]
    assert all(by_id[i]["component_id"] == i for i in range(6))
    assert nd.link_documents(none).count() == 0
    kept = nd.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert kept.where("doc_id = 3").count() == 3 and kept.where("doc_id is null").count() == 1


def test_band_layout_and_recall():
    for threshold in (0.8, 0.85):
        bands, rows = nd.band_layout(threshold)
        assert (1 - threshold**rows) ** bands <= nd.MISS and bands <= nd.MAX_BANDS
    rng, missed = random.Random(5), 0
    for _ in range(200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        a, b = shingle_set(" ".join(base), 3), shingle_set(edited(rng, base, 1), 3)
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.85
        missed += not np.any(nd.band_keys(a, 40, 5) == nd.band_keys(b, 40, 5))
    assert missed == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}


def test_repeated_rows_of_a_candidate_are_one_text(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words))] * 400 + [(2, " ".join([*words[:-1], "x"])), (3, " ".join([*words[:-1], "y"]))]
    seen, whole = [], nd._links

    def counted(members, texts, n, percent):
        seen.append(texts.count())
        return whole(members, texts, n, percent)

    monkeypatch.setattr(nd, "_links", counted)
    got = nd.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert found(got) == brute(rows, 3, 85) and got.count() == 402
    assert max(seen) == 3


def test_torn_buckets_are_searched_once(spark):
    """Buckets 1 and 2 hold the same three nodes, 3 and 4 nodes of component 10, 5 one component."""
    rows = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 2), (2, 3, 3)]
    rows += [(3, 10, 10), (3, 11, 10), (3, 20, 20), (4, 11, 10), (4, 12, 10), (4, 20, 20), (4, 30, 30)]
    rows += [(5, 10, 10), (5, 11, 10)]
    torn = nd._torn_buckets(spark.createDataFrame(rows, "bucket long, node long, label long"))
    got = {}
    for r in torn.collect():
        got.setdefault(r["block"], {})[r["node"]] = r["query"]
    assert got.pop("label:10") == {10: False, 11: False, 12: False, 20: True, 30: True}
    (alone,) = got.values()
    assert alone == {1: True, 2: True, 3: False}
    pairs = nd._search_blocks(torn).groupBy("block", "query").count().collect()
    assert sorted(r["count"] for r in pairs) == [2, 2, 3, 5]


def test_pages_of_one_template_equal_all_pairs(spark):
    """Pages that share half their words, in pairs of near copies: many candidates, few links."""
    rng, rows = random.Random(8), []
    frame = [f"t{i}" for i in range(60)]
    for _ in range(60):
        body = [f"w{rng.randrange(10**6)}" for _ in range(50)]
        rows += [" ".join(frame + body), " ".join(frame + [*body[:-2], "x", "y"])]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.link_documents(docs, 5, 80)) == brute(rows, 5, 80)
