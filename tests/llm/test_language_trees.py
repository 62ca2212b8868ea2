import math
import random
from collections import Counter, defaultdict

from foliomine.llm import language_trees as lt


def code_length(training, text, alphabet=256):
    """Bits of ``text`` by walking the contexts of a plain dictionary tree."""
    tree = defaultdict(Counter)
    for t in training:
        data = lt._START + t.lower()
        for i in range(lt.DEPTH, len(data)):
            for k in range(lt.DEPTH + 1):
                tree[data[i - k : i]][data[i]] += 1
    bits, data = 0.0, lt._START + text.lower()
    for i in range(lt.DEPTH, len(data)):
        for k in range(lt.DEPTH, -1, -1):
            seen = tree.get(data[i - k : i])
            if not seen:
                continue
            total, distinct = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += math.log2(alphabet)
    return bits


def test_code_lengths_equal_a_plain_tree():
    rng = random.Random(3)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n)).encode()
    training = {"a": [draw("abc é", 60) for _ in range(20)], "b": [draw("cde ß", 60) for _ in range(20)]}
    grams = {}
    for lang, texts in training.items():
        for size in range(1, lt.DEPTH + 2):
            counts = Counter()
            for t in texts:
                for code, n in zip(*lt.gram_counts(t, size)):
                    counts[int(code)] += int(n)
            import numpy as np

            codes = sorted(counts)
            grams[lang, size] = (np.array(codes), np.array([counts[c] for c in codes]))
    model = lt.Model(["a", "b"], grams)
    for text in [b"", b"a", b"abcabc", "zé ßx".encode(), draw("abcdeßé z", 80)]:
        got = model.code_lengths(text)
        for j, lang in enumerate("ab"):
            assert math.isclose(got[j], code_length(training[lang], text), rel_tol=1e-5, abs_tol=1e-5)


def test_held_out_accuracy(table):
    docs = table("documents", "sf0.01")
    rows = lt.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(documents, none):
    got = lt.identify(documents).collect()
    assert len(got) == documents.count()
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and by_id[0]["score"] == 0
    assert by_id[20]["lang_pred"] == "en" and not by_id[None]["held_out"]
    assert lt.identify(none).count() == 0
    nothing = lt.identify(documents.drop("lang").selectExpr("*", "cast(null AS string) AS lang"))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_repeated_rows_are_sampled_once(spark):
    rows = [(i, "xx", f"text of number {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = sorted(r["text"] for r in lt.training_sample(docs, 10).collect())
    hot = [r for r in rows if r[2] == want[0]] * 200
    got = lt.training_sample(docs.union(spark.createDataFrame(hot, docs.schema)), 10).collect()
    assert len(want) == 10 and sorted(r["text"] for r in got) == want
