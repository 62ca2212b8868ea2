import re
from collections import Counter

import pytest

from foliomine.operators import language as la


def grams(text):
    letters = re.sub(r"[^\W\d_]+|(.+?)(?=[^\W\d_]|$)", lambda m: " " if m.group(1) else m.group(0), text.lower(), flags=re.S)
    return [letters[i : i + 3] for i in range(len(letters) - 2)]


def ranked(counter, size):
    return [g for g, _ in sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:size]]


TEXTS = [
    ("en", "the cat sat on the mat, and the dog ran to the other end of the road"),
    ("de", "der Hund läuft über die Straße und die Katze sitzt auf der Matte"),
    ("fr", "le chat est assis sur le tapis et le chien court dans la rue"),
    ("en", "this is the house that the man built with the other man"),
]


@pytest.mark.parametrize("few", [True, False])
def test_detection_against_a_direct_computation(spark, texts, few):
    labelled = spark.createDataFrame(TEXTS, "lang string, text string")
    asked = [t for _, t in TEXTS] + ["die die die", "", "12", "ab", "aaaa aaaa", "xyz " * 2000 + "the"]
    profiles = {}
    for lang, text in TEXTS:
        profiles.setdefault(lang, Counter()).update(grams(text))
    profiles = {l: ranked(c, 300) for l, c in profiles.items()}
    languages = ["de", "en", "fr"]
    assert la.few_languages(labelled)
    made = la.profiles(labelled)
    assert {(r["lang"], r["gram"]): r["rank"] for r in made.collect()} == {
        (l, g): i + 1 for l, p in profiles.items() for i, g in enumerate(p)
    }
    got = {r["doc_id"]: (r["detected"], r["distance"]) for r in la.detect(texts(*asked), made, few).collect()}
    for i, text in enumerate(asked):
        own = ranked(Counter(grams(text)), 300)
        if not own:
            assert got[i] == ("en", None), text
            continue
        distance = {
            l: sum(abs(r - p.index(g)) if g in p else 300 for r, g in enumerate(own)) for l, p in profiles.items()
        }
        best = min(languages, key=lambda l: (distance[l], l))
        assert got[i] == (best, distance[best]), text


def test_ocr_language(evaluate):
    assert evaluate(la.ocr_language, "de", "fr", None) == ["deu", "eng", "eng"]


def test_any_number_of_languages(spark, texts):
    """Languages beyond the limit of the broadcast, nulls, and no profiles at all."""
    many = [(f"l{i:03}", "".join(chr(0x4E00 + 3 * i + k) for k in range(3)) * 3) for i in range(la.MAX_LANGUAGES + 5)]
    labelled = spark.createDataFrame([*many, (None, "abc")], "lang string, text string")
    assert not la.few_languages(labelled)
    made, asked = la.profiles(labelled), [t for _, t in many] + ["abcabc", None]
    got = {r["doc_id"]: (r["detected"], r["distance"]) for r in la.detect(texts(*asked), made).collect()}
    assert [got[i] for i in range(len(many))] == [(l, 0) for l, _ in many]
    assert got[len(many)] == ("l000", 3 * la.PROFILE_SIZE) and got[len(many) + 1] == ("en", None)
    none = {r["detected"] for r in la.detect(texts("abcabc"), made.limit(0)).collect()}
    assert none == {"en"}
