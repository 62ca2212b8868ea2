import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from foliomine.llm import source_audit as sa

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, settings):
    """Sorted result rows from plain counts of ``(text, lang, source)``."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(TERM.findall(text.translate(FOLD)))
        counts[lang, source] += found
        docs[lang].update(found.keys())
    out = []
    for lang in {r[1] for r in rows}:
        kept = {t for t, n in docs[lang].items() if n >= settings.min_docs}
        sources = sorted({r[2] for r in rows if r[1] == lang}, key=str.encode)

        def shares(count):
            count = {t: count[t] for t in kept}
            total = sum(count.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (n + 5) // total for t, n in count.items()}

        of = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(of[s][t] - of[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, of[s][t] - q[t]) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, settings.top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(found[:most], 1)]
    return sorted(out)


def found(spark, rows, settings):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    return sorted(tuple(r) for r in sa.audit_sources(docs, settings).collect())


def corpus(seed, n=250):
    rng = random.Random(seed)
    words = [f"{rng.choice(['Wort', 'é', 'x', 'straße', 'ǅ', 'K'])}{chr(97 + i % 26)}{'q' * (i % 5)}" for i in range(120)]
    rows = []
    for i in range(n):
        source = rng.choice(["a", "b", "b", "b", None, "é", "z"])
        own = words[(zlib.crc32((source or "").encode()) % 3) * 10 :] if source != "a" else words[:30]
        text = "".join(rng.choice(own) + rng.choice([" ", "\n", "1", "--", "@", "`", "{", "\x7f"]) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "en", "de", None]), source))
    return rows


@pytest.mark.parametrize("bits", [64, 6, 1])
def test_equals_plain_counts_whatever_collides(spark, bits):
    rows = corpus(1)
    settings = sa.Settings(min_docs=8, top=5, digest_bits=bits)
    expected = brute(rows, settings)
    assert found(spark, rows, settings) == expected and len(expected) > 80


def test_batches_and_tiles_change_nothing(monkeypatch):
    texts = [r[0].encode() for r in corpus(2)]
    whole = sa.Terms(texts, 64)
    assert [whole.string(i).decode() for i in range(len(whole.row))] == [
        t for text in texts for t in TERM.findall(text.decode().translate(FOLD))
    ]
    assert sorted({s for _, s in whole.distinct()}) == sorted({whole.string(i) for i in range(len(whole.row))})
    monkeypatch.setattr(sa, "BATCH_BYTES", 64)
    crowded = sa.Terms(texts, 3)
    assert {s for _, s in crowded.distinct()} == {s for _, s in whole.distinct()}


def test_ties_are_ranked_by_item(spark):
    rows = [("one two three four", "en", "a")] * 4 + [("five", "en", "b")] * 4 + [(None, "en", "c"), ("x", "fr", "a")]
    settings = sa.Settings(min_docs=4, top=2)
    got = found(spark, rows, settings)
    assert got == brute(rows, settings)
    assert [r[3] for r in got if r[:3] == ("en", "a", "term")] == ["four", "one"]
    assert not [r for r in got if r[0] == "fr"]


def test_odd_rows(documents, none, spark):
    rows = [(r["text"], r["lang"], r["source"]) for r in documents.collect()]
    settings = sa.Settings(min_docs=2, top=3)
    got = sorted(tuple(r) for r in sa.audit_sources(documents, settings).collect())
    assert got == brute(rows, settings)
    empty = sa.audit_sources(none)
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"] and empty.count() == 0
    nothing = [(None, None, "a"), ("", None, None)]
    assert found(spark, nothing, settings) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_many_sources_are_tiled(spark):
    rng = random.Random(9)
    rows = [(f"{rng.choice('abc')} d {rng.choice('xyz')}", "en", f"s{i % 520}") for i in range(700)]
    settings = sa.Settings(min_docs=10, top=2)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sa.audit_sources(docs, settings)
    assert got.where("part = 'pair'").count() == 520 * 519
    expected = {r for r in brute(rows, settings) if r[1] in ("s0", "s519")}
    assert {tuple(r) for r in got.where("source in ('s0', 's519')").collect()} == expected
