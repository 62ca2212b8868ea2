import random
import re

import pytest
from hypothesis import given, settings, strategies as hs
from pyspark.sql import functions as F

from foliomine.operators import templates as tp
from foliomine.plans import inputs
from foliomine.sources import pages as pg, templates as tt

SEARCH = re.I | re.M


@pytest.fixture(scope="module")
def documents(spark):
    """Rendered statements and fee statements, and shuffled mixtures of their lines."""
    rendered = inputs.rendered(spark, "/root/testdata/sf0.001")
    values = [r["text"] for r in rendered.collect()]
    rng = random.Random(1)
    pool = [line for v in values for line in v.split("\n")]
    values += ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    values += ["", "ING-DIBA AG\nKONTOAUSZUG", "Entgeltaufstellung Girokonto", "Eingeräumte Kontoüberziehung"]
    frame = spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")
    return values, inputs.with_layout(frame)


def page_one(text):
    return "\n".join(text.split("\n")[:40])


def kind(text):
    scores = {t.name: sum(len(re.findall(p, page_one(text), re.I)) for p in t.identifiers) for t in tt.BUILTIN_TEMPLATES}
    best = max(scores.items(), key=lambda s: s[1])
    return best[0] if best[1] else None


def zone_text(text, bounds):
    x1, y1, x2, y2 = bounds
    lines, out = page_one(text).split("\n"), []
    for i, line in enumerate(lines):
        words = [w for w in line.split(" ") if w]
        inside = [
            w for j, w in enumerate(words)
            if j / len(words) < x2 and (j + 1) / len(words) > x1
            and i / len(lines) < y2 and (i + 1) / len(lines) > y1
        ]
        if inside:
            out.append(" ".join(inside))
    return "\n".join(out)


def test_zones_matches_and_confidence_against_python(documents):
    values, frame = documents
    zoned = tp.with_zones(tp.classify(frame)).select(
        "doc_id", "doc_type", "zones", tp.confidence(F.col("zones")).alias("c"),
        tp.joined_zone_text(F.col("zones")).alias("joined"),
    ).collect()
    assert len(zoned) == len(values)
    for row in zoned:
        text = values[row["doc_id"]]
        assert row["doc_type"] == kind(text)
        if row["doc_type"] is None:
            assert row["zones"] is None and row["c"] is None
            continue
        template = next(t for t in tt.BUILTIN_TEMPLATES if t.name == row["doc_type"])
        total, joined = 0.0, []
        for zone, got in zip(template.zones, row["zones"], strict=True):
            expected = zone_text(text, zone.bounds)
            assert got["text"] == expected
            found = [
                (no, m.group(0), list(m.groups()))
                for no, p in enumerate(zone.patterns) for m in re.finditer(p, expected, SEARCH)
            ]
            assert [(m["pattern_no"], m["text"], m["groups"]) for m in got["matches"]] == found
            total += len(found) / len(zone.patterns)
            if expected:
                joined.append(f"[{zone.name}]\n{expected}")
        assert row["c"] == pytest.approx(total / len(template.zones))
        assert row["joined"] == "\n\n".join(joined)


def standard(key, value):
    if any(w in key for w in ("amount", "balance", "total")):
        try:
            return float(value.replace("EUR", "").replace("€", "").strip().replace(".", "").replace(",", "."))
        except ValueError:
            return 0.0
    parts = value.split(".")
    if any(w in key for w in ("date", "period")) and len(parts) == 3:
        return f"{parts[2].strip()}-{parts[1].strip():0>2}-{parts[0].strip():0>2}"
    return value


def test_fields_against_python(documents):
    values, frame = documents
    rows = tp.classify(frame).select("doc_id", "doc_type", tp.fields("page_text").alias("fields"))
    got = {}
    for r in tp.field_rows(rows).collect():
        got.setdefault(r["doc_id"], {})[r["key"]] = r["value"] if r["value_num"] is None else r["value_num"]
    for i, text in enumerate(values):
        template = next((t for t in tt.BUILTIN_TEMPLATES if t.name == kind(text)), None)
        expected = {}
        for key, p in (template.fields if template else {}).items():
            for m in re.finditer(p, page_one(text), SEARCH):
                expected[key] = standard(key, m.group(1))
        assert got.get(i, {}) == expected


def test_word_rows_give_the_same_zones(documents):
    _, frame = documents
    words = tp.rows_of(frame.withColumn("page_no", F.lit(1)), F.inline_outer("words"), "word_no", "page_no")
    other_page = words.withColumn("page_no", F.lit(2))
    types = tp.classify(frame).select("doc_id", "doc_type")
    gathered = pg.gather_words(words.unionByName(other_page))
    assert gathered.where("page_no = 2").count() == gathered.where("page_no = 1").count() > 0
    from_rows = types.join(gathered.where("page_no = 1"), "doc_id", "left")
    key = lambda r: (r["doc_id"], r["zone_no"])
    a = sorted(tp.zone_rows(tp.with_zones(tp.classify(frame))).collect(), key=key)
    b = sorted(tp.zone_rows(tp.with_zones(from_rows)).collect(), key=key)
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_page_size_scales_the_bounds(spark, documents):
    _, frame = documents
    wide = frame.withColumn(
        "words",
        F.transform("words", lambda w: w.withField("x0", w["x0"] * 600).withField("x1", w["x1"] * 600)
                    .withField("top", w["top"] * 800).withField("bottom", w["bottom"] * 800)),
    )
    texts = lambda d, **size: sorted(map(tuple, tp.zone_rows(tp.with_zones(tp.classify(d), **size)).collect()))
    assert texts(wide, width="600.0D", height="800.0D") == texts(frame)


def test_user_templates_round_trip_and_classify(spark, texts, tmp_path):
    own = [
        tt.Template("a", ["it's", r"x\d"]),
        tt.Template("b", ["x"], [tt.Zone("all", (0, 0, 1, 1), "text", [r"(x)(y)?", "'"], True)], {"n": r"n=(\d+)"}),
    ]
    path = str(tmp_path / "templates")
    tt.template_rows(spark, own + tt.BUILTIN_TEMPLATES).write.json(path)
    read = tt.templates_from(spark.read.schema(tt.TEMPLATE_ROW).json(path))
    assert read == own + tt.BUILTIN_TEMPLATES
    with pytest.raises(ValueError):
        tt.templates_from(tt.template_rows(spark, own), max_patterns=3)
    docs = inputs.with_layout(texts("It's x1", "x n=7 n=8 it's x", "x1 x", "none"))
    typed = tp.classify(docs, own).orderBy("doc_id")
    assert [(r["doc_type"], r["score"]) for r in typed.collect()] == [("a", 2), ("b", 2), ("b", 2), (None, 0)]
    rows = tp.classify(docs, own).select("doc_id", "doc_type", tp.fields("page_text", own).alias("fields"))
    assert [(r["doc_id"], r["key"], r["value"]) for r in tp.field_rows(rows).collect()] == [(1, "n", "8")]
    matches = tp.match_rows(tp.with_zones(typed, own)).where("doc_id = 1").collect()
    assert [(m["pattern_no"], m["groups"]) for m in matches] == [(0, ["x", None]), (0, ["x", None]), (1, [])]
    assert tp.scores(docs, own).count() == 8


@settings(max_examples=500, deadline=None)
@given(hs.text(alphabet="aB 1\n.", max_size=40).map(lambda t: t.replace("1", "12345")))
def test_the_possessive_address_pattern_finds_the_same(text):
    plain = r"([A-Za-zäöüÄÖÜß]+[^\n]+)\s*\n\d{5}\s+[A-Za-zäöüÄÖÜß]+"
    ours = tt.BUILTIN_TEMPLATES[1].fields["address"]
    spans = lambda p: [(m.span(), m.group(1)) for m in re.finditer(p, text, SEARCH)]
    assert spans(ours) == spans(plain)


def test_zones_from_lines_equal_those_from_words(documents):
    """Of a plain text's layout zones are cut from its lines; a string without them cuts words.
    The number of matches, where it alone is asked for, is that of the matches."""
    rng = random.Random(8)
    values, frame = documents
    spark = frame.sparkSession
    spaced = [re.sub(" ", lambda m: rng.choice([" ", "  ", "   "]), v).replace("\n", rng.choice(["\n", "\n\n ", " \n"])) for v in values[:150]]
    rows = spark.createDataFrame(list(enumerate(values + spaced)), "doc_id bigint, text string")
    typed = tp.classify(inputs.with_first_page(rows))
    words = pg.words_from_text("page_text")
    cut = {
        name: tp.with_zones(typed, words=by, counted=counted)
        for name, by, counted in (("words", str(words) + " ", False), ("lines", words, False), ("counted", words, True))
    }
    assert not hasattr(str(words) + " ", "lines")
    texts = lambda f: {r["doc_id"]: [z["text"] for z in r["zones"] or []] for r in f.collect()}
    expected = texts(cut["words"])
    assert texts(cut["lines"]) == expected and sum(map(len, expected.values())) > 300
    value = lambda f, **k: sorted(f.select("doc_id", tp.confidence(F.col("zones"), **k).alias("c")).collect())
    assert value(cut["counted"], counted=True) == value(cut["words"])


def test_a_text_without_identifiers_is_searched_once(spark):
    """The types are those of the scores; templates whose patterns can't be joined have them too."""
    odd = [tt.Template("a", [r"(x)\1"]), tt.Template("b", ["b|c", "q?z"])]
    said = ["xx", "x", "B", "kk z", "nothing", "", None, "Konto Girokonto", "ENTGELTAUFSTELLUNG", "gezahlte  Entgelte"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id int, page_text string")
    for templates in (tt.BUILTIN_TEMPLATES, odd, odd[1:], [*odd, tt.Template("c", [])]):
        got = {r["doc_id"]: (r["doc_type"], r["score"]) for r in tp.classify(docs, templates).collect()}
        for i, t in enumerate(said):
            counts = [sum(len(re.findall(f"(?i){p}", t or "")) for p in x.identifiers) for x in templates]
            best = max(counts, default=0)
            assert got[i][0] == (templates[counts.index(best)].name if best else None), (t, templates)
            if t is not None:
                assert got[i][1] == best
    assert tp._either(tt.BUILTIN_TEMPLATES) and tp._either(odd) is None and tp._either(odd[1:])
