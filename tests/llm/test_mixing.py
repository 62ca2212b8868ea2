import math
from collections import Counter

import pytest

from foliomine.llm import mixing as mx


def corpus(spark):
    rows = [(i, "w " * (5 + i % 40), "big") for i in range(2000)]
    rows += [(10000 + i, "w " * (5 + i % 30), f"s{i % 9}") for i in range(1350)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def tokens_by_source(docs):
    out = Counter()
    for r in docs.collect():
        out[r["source"]] += len((r["text"] or "").split()) + 1
    return out


def entropy_share(weights):
    total = sum(weights)
    return -sum(w / total * math.log(w / total) for w in weights) / math.log(len(weights))


def test_weights_reach_the_entropy_and_use_every_document(spark):
    docs = corpus(spark)
    own = tokens_by_source(docs)
    assert entropy_share(list(own.values())) < 0.9
    got = mx.mix(docs, mx.Target(entropy=0.9, max_repeats=10, block_tokens=4000)).collect()
    assert len({r["doc_id"] for r in got}) == docs.count()
    held = Counter()
    for r in got:
        held[r["source"]] += r["n_tokens"]
    assert abs(entropy_share(list(held.values())) - 0.9) < 0.01
    copies = Counter(r["doc_id"] for r in got)
    for doc, n in copies.items():  # passes are whole but for the last
        assert n >= 1
    by_source = {s: {copies[r["doc_id"]] for r in got if r["source"] == s} for s in own}
    assert all(max(c) - min(c) <= 1 for c in by_source.values())


def test_blocks_hold_the_sources_in_the_same_weights(spark):
    docs = corpus(spark)
    got = mx.mix(docs, mx.Target(entropy=0.9, max_repeats=10, block_tokens=8000)).collect()
    total, blocks = Counter(), {}
    for r in got:
        total[r["source"]] += r["n_tokens"]
        blocks.setdefault(r["block"], []).append(r)
    assert len(blocks) > 5 and sorted(blocks) == list(range(len(blocks)))
    for rows in blocks.values():
        assert sorted(r["slot"] for r in rows) == list(range(1, len(rows) + 1))
        big = sum(r["n_tokens"] for r in rows if r["source"] == "big")
        share = big / sum(r["n_tokens"] for r in rows)
        assert abs(share - total["big"] / total.total()) < 0.06
        assert rows != sorted(rows, key=lambda r: r["source"])


def test_the_repetition_limit_wins(spark):
    docs = corpus(spark)
    got = mx.mix(docs, mx.Target(entropy=1.0, max_repeats=2)).collect()
    own, held = tokens_by_source(docs), Counter()
    for r in got:
        held[r["source"]] += r["n_tokens"]
    assert max(held[s] / own[s] for s in own) <= 2.0
    assert max(held[s] / own[s] for s in own) > 1.8


def test_a_set_budget_is_not_exceeded(spark):
    docs = corpus(spark)
    got = mx.mix(docs, mx.Target(entropy=0.95, max_repeats=4, budget=20000)).collect()
    assert 18500 < sum(r["n_tokens"] for r in got) <= 20000 + 10


def test_mixed_rows_are_those_of_the_mixture(spark):
    docs = corpus(spark).withColumnRenamed("source", "source").selectExpr("*", "1 AS pass", "2 AS place")
    target = mx.Target(entropy=0.9, max_repeats=3)
    mixed = mx.mix_documents(docs, target)
    assert mixed.columns == docs.columns
    expected = Counter(r["doc_id"] for r in mx.mix(docs, target).collect())
    assert Counter(r["doc_id"] for r in mixed.collect()) == expected


def test_odd_rows(documents, none):
    got = mx.mix(documents).collect()
    assert len(got) >= documents.count()
    assert {r["source"] for r in got} == {"s", None}
    assert mx.mix(none).count() == 0 and mx.mix_documents(none).count() == 0
    assert mx.mix_documents(documents).columns == documents.columns
    assert mx.mix_documents(documents).count() == len(got)


def bisected(shares, total, target):
    """The exponent by plain bisection of each of its two bounds."""
    def weights(a):
        powers = {s: x**a for s, x in shares.items()}
        return {s: p / sum(powers.values()) for s, p in powers.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a).values()) / math.log(len(shares))

    def repeats(a):
        w = weights(a)
        budget = target.budget or max(total * shares[s] / w[s] for s in shares)
        return max(w[s] * budget / (shares[s] * total) for s in shares)

    def last(holds, low, high):
        """Where ``holds``, true at ``high``, starts."""
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if holds(middle) else (middle, high)
        return high

    if entropy(1.0) >= target.entropy:
        return 1.0
    diverse = last(lambda a: entropy(a) < target.entropy, 0.0, 1.0)
    rare = last(lambda a: repeats(a) <= target.max_repeats, 0.0, 1.0)
    return max(diverse, rare)


def expected_mixture(docs, target):
    """``(doc_id, pass) -> (source, tokens, block)`` with Spark's hashes and plain loops."""
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("s"), mx.n_tokens(F.col("text")).alias("n_tokens"))
    rows = rows.withColumn("places", F.array(*(mx._order(F.lit(p)) for p in range(12)))).collect()
    own = Counter()
    for r in rows:
        own[r["s"]] += r["n_tokens"]
    total = own.total()
    budget = target.budget and min(target.budget, math.floor(total * target.max_repeats))
    target = mx.Target(target.entropy, target.max_repeats, budget, target.block_tokens)
    shares = {s: n / total for s, n in own.items()}
    a = bisected(shares, total, target)
    powers = {s: x**a for s, x in shares.items()}
    z = sum(powers.values())
    wanted = budget if budget is not None else total * z * max(shares.values()) ** (1 - a)
    out = {}
    n_blocks = max(1, -(-int(wanted) // target.block_tokens))
    for s in own:
        most = round(powers[s] / z * wanted)
        most = min(most if budget is not None else max(most, own[s]), math.floor(own[s] * target.max_repeats))
        at = 0
        for p in range(-(-most // own[s])):
            for r in sorted((r for r in rows if r["s"] == s), key=lambda r: (r["places"][p], r["doc_id"])):
                if at + r["n_tokens"] <= most:
                    block = min(int(at * n_blocks / most), n_blocks - 1)
                    out[r["doc_id"], p] = (s, r["n_tokens"], block)
                at += r["n_tokens"]
    return out


@pytest.mark.parametrize(
    "target",
    [
        mx.Target(entropy=0.9, max_repeats=10, block_tokens=4000),
        mx.Target(entropy=0.97, max_repeats=2.5, block_tokens=9000),
        mx.Target(entropy=0.95, max_repeats=4, budget=20_000, block_tokens=3000),
        mx.Target(entropy=0.95, max_repeats=2, budget=10**6, block_tokens=30_000),
    ],
)
def test_equals_plain_loops(spark, target):
    docs = corpus(spark).where("doc_id % 3 = 0")
    got = mx.mix(docs, target).collect()
    expected = expected_mixture(docs, target)
    assert {(r["doc_id"], r["pass"]): (r["source"], r["n_tokens"], r["block"]) for r in got} == expected
    assert len(got) == len(expected)


def test_the_limit_cuts_a_set_budget(spark):
    rows = [(i, "w " * 9, "ab"[i % 2]) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = Counter(r["doc_id"] for r in mx.mix(docs, mx.Target(budget=100_000, max_repeats=2)).collect())
    assert set(copies.values()) == {2} and len(copies) == 1000
    with pytest.raises(ValueError, match="max_repeats"):
        mx.mix(docs, mx.Target(max_repeats=0.5))


def test_columns_of_any_name_come_back(spark):
    docs = corpus(spark).where("doc_id < 300").selectExpr(
        "*", "1 AS reach", "'k' AS _key", "-5 AS _tokens", "'c' AS _copy", "7 AS row", "8 AS key", "9 AS n_tokens", "10 AS `a.b`"
    )
    mixed = mx.mix_documents(docs, mx.Target(entropy=0.9, max_repeats=3))
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} == {tuple(r) for r in docs.collect()}
