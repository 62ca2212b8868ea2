import html
import re

from foliomine.llm import main_content as mc


def marked(page):
    """The article's blocks by its mark."""
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_supplied_pages(table):
    pages = table("pages", "sf0.01")
    rows = mc.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    assert [r["page_id"] for r in rows if r["text"] != marked(r["html"])] == []
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>";</script></head>
<body><header class="masthead">Site name and motto</header><nav><ul><li><a href=/>Home</a><li><a href="/x>y">News</a></ul></nav>
<div class="cookie-notice">We use cookies for a very long list of reasons that fills a line</div>
<div id=content><h1>Head&amp;line</h1><p>First  <b>bold</b> words
of the text &lt;here&gt;.</p><div class="ad">Buy this now</div><p>Second part, with a <a href="#">link</a>, and more words to read.</p>
<form>Your mail <input name=q> please</form><p>Third part closes the article with some words.</p></div>
<aside>Related stories</aside><section class="comments"><p>I do not agree at all with what is said in this text</p></section>
<footer>&copy; all rights</footer></body></html>"""


def test_page_without_mark():
    assert mc.extract(PAGE) == (
        "Head&line\nFirst bold words of the text <here>.\n"
        "Second part, with a link, and more words to read.\nThird part closes the article with some words."
    )


def test_broken_markup():
    assert mc.extract("just words") == "just words"
    assert mc.extract("<p>a < b and <p>c<!-- never closed words") == "a < b and\nc"
    assert mc.extract('<div class="x><p>one two three') in ("one two three", "")
    assert mc.extract("<article><p>a&nbsp;b &#233;&am</p>") == "a b é&am"
    assert mc.extract("<nav>menu</nav>") == mc.extract("") == mc.extract(None) == ""
    assert mc.extract("<script>never closed <p>words") == ""


def test_weights_follow_labelled_pages():
    page = "<div>{}</div><article><p>{}</p></article><div>tail</div>"
    counts = mc.count_tags(page.format("menu", "many words of text " * 5))
    weights = mc.learn({k: tuple(v) for k, v in counts.items()})
    assert weights.word > 0.5 and weights.tags["div"] < weights.tags["p"] <= -0.1
    assert mc.count_tags("<p>no mark</p>") is None and mc.learn({}) == mc.Weights()


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>text of a page</p>"), (3, "u", ""), (4, "u", "<p>" + "word " * 50000)]
    pages = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = mc.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {(r["page_id"], r["n_chars"]) for r in got.collect()} == {(1, 0), (None, 14), (3, 0), (4, 249999)}
    assert got.count() == 5 and mc.extract_pages(pages.where("false")).count() == 0


def test_insets_part_no_text(table):
    said, closing = "word " * 500, "end " * 40
    advert = '<div class="ad">' + "<p><a href=#>buy</a> " * 60 + "</div>"
    items = "<ul>" + "".join(f'<li><a href="/{i}">source number {i}</a></li>' for i in range(5)) + "</ul>"
    for inset in (advert, f"<aside>{'note ' * 60}</aside>", f"<form><ul>{'<li>field</li>' * 60}</ul></form>"):
        page = f"<div><p>{said}</p>{inset}<p>{closing}</p>{items}<p><a href=#>{closing}</a></p></div>"
        want = [said.strip(), closing.strip(), *(f"source number {i}" for i in range(5)), closing.strip()]
        for weights in (mc.Weights(), mc.fit(table("pages", "sf0.01"))):
            assert mc.extract(page, weights).split("\n") == want


def test_tags_cost_a_quarter_of_a_word_at_most():
    weights = mc.learn({"": (5000, 10), "li": (0, 9000), "a": (0, 9000), "p": (900, 3)})
    assert weights.tags["li"] == weights.tags["a"] == -weights.word / 4 <= weights.other
    assert mc.learn({"": (1, 900), "li": (0, 9000)}).other == -0.125


def test_names_around_the_page_are_no_boilerplate():
    said = " ".join(f"word{i}" for i in range(200))
    inner = f"<nav>menu</nav><h1>Head</h1><p>{said}</p><div class='site-ad'>Buy this</div><p>The end</p>"
    want = f"Head\n{said}\nThe end"
    for page in (
        f'<html class="has-cookies"><body class="page has-sidebar">{inner}</body></html>',
        f'<body class="sidebar">{inner}</body>',
        f'<div class="with-header">{inner}</div><footer>foot</footer>',
        f'<body><div id="page-header"><div class="widget">{inner}</div></div></body>',
        f"<body><form id=f>{inner}</form></body>",
        f'<head><title>T</title><body><p class="notice">Note<p>{inner}',
        f'<body><div class="share-story">{inner}</div></body>',
        f'<div class="ad">never closed<div>{inner}</div>',
    ):
        assert mc.extract(page).endswith(want) and "Buy" not in mc.extract(page)
    learned = mc.Weights(boilerplate=frozenset(["div.story"]))
    assert mc.extract(f'<body><div class="story">{inner}</div></body>', learned) == want


def test_names_of_smaller_elements_stay_boilerplate():
    said = "word " * 20
    for name in ("comments", "user-comments", "x share"):
        page = f"<div><p>{said}</p><div class='{name}'>{'other ' * 60}</div><p>closing</p></div>"
        assert mc.extract(page) == said.strip() + "\nclosing"
    assert mc.extract(f"<p>{said}</p><aside>{'other ' * 900}</aside>") == said.strip()


def test_elements_around_the_mark_are_not_counted_outside():
    page = '<body class="b"><div class="story"><p class="ad">x</p><article><p>text</p></article></div></body>'
    counts = mc.count_tags(page)
    assert "div.story" not in counts and "body.b" not in counts and counts["p.ad"] == [0, 1]


PLAIN = (
    '<body><div id="page"><div><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport pages</a></div>'
    "<div>{article}</div>"
    "<div>&copy; 2024 The Site, all rights reserved <a href=i>Imprint</a></div></div></body>"
)
ARTICLE = "<h1>The head</h1><p>{}</p><p>Short end</p><ul><li><a href=1>see also one</a></li><li><a href=2>and two</a></li></ul>"


def test_the_scan_leaves_out_menus_and_footers_in_plain_divisions(table, monkeypatch):
    said = " ".join(f"word{i}" for i in range(60))
    page = PLAIN.format(article=ARTICLE.format(said))
    want = f"The head\n{said}\nShort end\nsee also one\nand two"
    learned = mc.fit(table("pages", "sf0.01"))
    for weights in (mc.Weights(), learned):
        assert mc.extract(page, weights) == want
    with monkeypatch.context() as patch:
        patch.setattr(mc, "best_range", lambda scores: (0, len(scores)))
        whole = mc.extract(page)
    assert whole.startswith("Home") and whole.endswith("Imprint") and want in whole


def test_words_of_kinds_seen_outside_count_against():
    weights = mc.Weights(kinds={"p.teaser": -1.0, "p": 0.8, "li a": 0.5})
    page = "<div><p class=teaser>{0}</p></div><section><p>{0}</p></section><div><ul><li><a>short link to the next page</a></ul></div>"
    said = "some words that fill a line of text in this place here"
    assert mc.extract(page.format(said), weights).split("\n") == [said, "short link to the next page"]
    assert mc.extract(page.format(said)).split("\n") == [said, said]


def test_text_straight_in_a_division_is_content_if_it_is_long():
    said = "word " * 40
    assert mc.extract(f"<div>Menu</div><div>{said}<br>{said}</div><div>Foot note</div>") == " ".join((said + said).split())
    assert mc.extract("<div>few words</div>") == "few words"
    assert mc.extract("<div><a href=1>one</a> <a href=2>two</a></div>") == ""


def test_best_range_equals_all_ranges():
    import random

    rng = random.Random(1)
    for _ in range(400):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randrange(12))]
        start, end = mc.best_range(scores)
        totals = [sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1)]
        assert sum(scores[start:end]) == max(totals)


def test_the_region_has_the_highest_total_of_all(table):
    """The blocks chosen on supplied pages by comparing every pair of ends."""
    weights = mc.fit(table("pages", "sf0.01"))
    for row in table("pages").limit(40).collect():
        found = list(mc.tokens(row["html"]))
        outside = mc._outside(found, weights)
        blocks = mc.blocks_of(found, [not o for o in outside])
        costs = [0.0 if o or f[0] == "text" else weights.tags.get(f[2], weights.other) for f, o in zip(found, outside)]
        total = lambda i, j: sum(mc.score_block(b, weights) for b in blocks[i:j]) + sum(costs[blocks[i].first : blocks[j - 1].last])
        best = max(total(i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks) + 1))
        first, last = mc._region(found, blocks, outside, weights)
        assert total(first, last) >= best - 1e-6 or blocks[first].inside == blocks[last - 1].inside


def test_hostile_markup_takes_linear_time():
    import time

    n = 1 << 20
    for page in (
        "<a " * (n // 3), "<a '" * (n // 4), '<a ">"' * (n // 6), "<!" * (n // 2), "<!--" * (n // 4), "</" * (n // 2),
        "<script " * (n // 8), "<script>" * (n // 8), "<svg></svg " * (n // 11), "<b>" * 50_000 + "</i>" * 100_000,
        "<div>" * 100_000 + "x" + "</p>" * 100_000, "<p>" * (n // 3), "<a href=1>b</a>" * (n // 15), "&" * n, "<li><ul>" * 50_000,
    ):
        begun = time.time()
        mc.extract(page)
        assert time.time() - begun < 10, page[:20]
