"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of blocks of text and of tags between them. A block scores by
its words: positive where the element that holds such words is seen in articles, negative
where it is seen around them, where most words are short links, or where a few words stand
alone outside of any paragraph. Tags score negative. One linear scan finds the contiguous
region of the highest total, and the blocks next to it in its own element complete it.

The text is that of the region's blocks without the boilerplate elements inside it, those
that their names tell. They score nothing, so that an inset of any length parts no text
from the rest.

Weights come from labelled pages: pages that mark their article by one ``article``
or ``main`` element. How often a tag, or a word of a block of some kind, stands inside and outside the mark
gives its log-odds; a tag costs a quarter of a word at most. Pages are scored without use of
the mark.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

LABELLED_PAGES = 2000
TAG_FLOOR = 0.25  # what a tag costs at most, in words
WRAPPER = 20  # words in an element around the content for one outside, at least

LEAST_WORDS = 12  # words outside of any paragraph that are needed to be content
LONG_LINK = 8  # words of a link that is text, not a way to somewhere
MOST = 20  # words of a block that count against a region
LEAST_SEEN = 50  # words of a kind of block whose log-odds are used

_TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.IGNORECASE)
_TAG_STOP = re.compile(r"[>\"']")
RAW = {
    name: re.compile(rf"</{name}\s*>", re.IGNORECASE)
    for name in "script style noscript template svg iframe textarea select".split()
}
_LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
BOILERPLATE = frozenset("aside button footer form head header menu nav title".split())
# Class, id and role names that mark boilerplate, alone or as the last part behind - or _.
CUES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies dialog disqus footer gdpr header masthead menu modal nav navbar navigation newsletter "
    "notice pagination popup promo promoted related respond share sharing sidebar skip social "
    "sponsor sponsored subscribe toolbar widget".split()
)
# First parts of names that say what an element has beside or in it, not what it is.
HAVING = frozenset("has have no with without".split())
CONTENT = frozenset(["article", "main"])
# Elements whose words are text; other ones hold such elements.
PARAGRAPHS = frozenset(
    "blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split()
)
LISTS = frozenset("dl figure menu ol table tbody tfoot thead tr ul".split())
HEAD = frozenset("base link meta title".split())
# Open elements of the second kind end where one of the first kind begins, if innermost.
ENDS = {name: frozenset("p") for name in BLOCKS - {"caption", "legend"}} | {
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "tr": frozenset(["td", "th", "tr", "p"]),
}


@dataclass(frozen=True)
class Weights:
    """Scores of a word and of tags by ``key``; other tags score ``other``."""

    word: float = 2.0
    tags: dict = field(default_factory=dict)
    other: float = -0.5
    boilerplate: frozenset = frozenset()  # keys of elements that are never content
    kinds: dict = field(default_factory=dict)  # share of a word's score, by kind of block


def _key(name: str, attributes: str) -> tuple[str, list[str]]:
    labels = ["".join(found) for found in _LABEL.findall(attributes)] if "=" in attributes else []
    first = labels[0].split()[:1] if labels else []
    return (f"{name}.{first[0].lower()}" if first else name), labels


def _tag_end(page: str, start: int) -> int:
    """Place of the ``>`` that ends a tag, not inside quotes; -1 where there is none."""
    at = start
    while found := _TAG_STOP.search(page, at):
        if found[0] == ">":
            return found.start()
        at = page.find(found[0], found.end()) + 1
        if not at:
            break
    return -1


def tokens(page: str) -> Iterator[tuple[str, str, str, list[str]]]:
    """``(kind, name, key or text, labels)``; the kind is text, open or close.

    Every step goes on behind what it has read. Only a search for the end of a tag may
    read on in vain, as far as the page's end; after one such search, tags end at the next ``>``.
    """
    at, last, quotes = 0, page.rfind(">"), True
    text = 0  # where the text begins that is not given out yet
    while at < len(page):
        start = page.find("<", at)
        if start < 0 or start > last:  # no tag is to come, a comment may
            start = page.find("<!--", max(at, last + 1))
            end = len(page) if start < 0 else start
            if text < end:
                yield "text", "", page[text:end], []
            return
        tag = _TAG.match(page, start)
        if not tag and page[start + 1 : start + 2] not in ("!", "?"):
            at = start + 1
            continue
        if text < start:
            yield "text", "", page[text:start], []
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
        elif not tag:
            at = page.find(">", start) + 1
        else:
            name = tag[2].lower()
            if not tag[1] and name in RAW:
                close = RAW[name].search(page, page.find(">", start))
                at = text = close.end() if close else len(page)
                continue
            end = _tag_end(page, tag.end()) if quotes else -1
            quotes = end >= 0
            end = end if quotes else page.find(">", start)
            at = end + 1
            if tag[1]:
                yield "close", name, name, []
            else:
                key, labels = _key(name, page[tag.end() : end])
                yield "open", name, key, labels
        text = at
    if text < len(page):
        yield "text", "", page[text:], []


def _is_cue(label: str) -> bool:
    parts = re.split(r"[_-]+", label)
    return label in CUES or parts[-1] in CUES and parts[0] not in HAVING


def _is_boilerplate(name: str, key: str, labels: list[str], weights: Weights) -> bool:
    """By name alone; ``_outside`` decides on elements around most of a page."""
    if name in ("html", "body"):
        return False
    if name in BOILERPLATE or key in weights.boilerplate:
        return True
    return any(_is_cue(part) for label in labels for part in label.lower().split())


class _Open:
    """The elements that are open, the last one innermost, each with a value."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.names: Counter = Counter()

    def push(self, name: str, value) -> None:
        self.stack.append((name, value))
        self.names[name] += 1

    def _pop(self) -> tuple:
        entry = self.stack.pop()
        self.names[entry[0]] -= 1
        return entry

    def step(self, kind: str, name: str) -> list[tuple]:
        """Takes out the elements that a tag ends and returns them, last one first."""
        ended = []
        if kind == "open":
            if name == "body" and not self.names["body"]:
                while self.stack and self.stack[-1][0] != "html":
                    ended.append(self._pop())
            elif name not in HEAD and self.stack and self.stack[-1][0] == "head":
                ended.append(self._pop())
            while self.stack and self.stack[-1][0] in ENDS.get(name, ()):
                ended.append(self._pop())
        elif self.names[name]:
            while not ended or ended[-1][0] != name:
                ended.append(self._pop())
        return ended


def _outside(found: list[tuple], weights: Weights) -> list[bool]:
    """Whether each token stands in boilerplate or is a tag of it.

    An element with a name of boilerplate is none when it holds most of the page's words
    and either a first heading or nearly all words outside the others: it stands around
    the content. Elements closed by their own tag whose tag means boilerplate always are.
    """
    # Of each marked element, and first of the page: the marked one around it, whether
    # it is boilerplate in any case, its words outside other marked ones, whether it has h1.
    around, certain, own, heading = [0], [False], [0], [False]
    elements = _Open()
    inner, owners = 0, []
    for kind, name, key, labels in found:
        if kind == "text":
            own[inner] += len(key.split())
            owners.append(inner)
            continue
        owner = inner
        for ended, before in elements.step(kind, name):
            if kind == "close" and ended == name and inner != before:
                certain[inner] = name in BOILERPLATE and name != "form"
            inner = before
        if kind == "open":
            if name not in VOID:
                elements.push(name, inner)
                if _is_boilerplate(name, key, labels, weights):
                    around.append(inner)
                    certain.append(name == "head")
                    own.append(0)
                    heading.append(False)
                    inner = len(own) - 1
            heading[inner] |= name == "h1"
            owner = inner
        owners.append(owner)
    words = own.copy()
    for i in range(len(own) - 1, 0, -1):
        if not certain[i]:
            words[around[i]] += words[i]
            heading[around[i]] |= heading[i]
    bad, rest = [False], own[0]
    for i in range(1, len(own)):
        most = 2 * words[i] > words[0] and (heading[i] or WRAPPER * rest < words[i])
        bad.append(bad[around[i]] or certain[i] or not most)
        rest += 0 if bad[i] else own[i]
    return [bad[i] for i in owners]


@dataclass
class Block:
    """Text between two tags of blocks."""

    first: int  # of its tokens
    last: int
    kind: str  # of the innermost element that holds blocks, with " a" where links prevail
    name: str
    words: int
    inside: int  # the element around its paragraph or list


def blocks_of(found: list[tuple], counted: list[bool]) -> list[Block]:
    """The blocks of the tokens that count, in order; one without words is none."""
    elements = _Open()
    out: list[Block] = []
    # Key, name and number of the innermost block element, and the number of the innermost
    # one that is neither a paragraph nor a list.
    around = ("", "", -1, -1)
    link = -1  # the open link
    first, words, link_words, held, edge = 0, 0, Counter(), ("", "", -1, -1), True

    def end(at: int) -> None:
        nonlocal words, link_words
        if words:
            short = sum(n for n in link_words.values() if n < LONG_LINK)
            kind = held[0] + (" a" if 2 * short >= words else "")
            out.append(Block(first, at, kind, held[1], words, held[3]))
        words, link_words = 0, Counter()

    for i, (kind, name, key, _) in enumerate(found):
        if kind == "text":
            n = len(key.split()) if counted[i] else 0
            if n and not words:
                first, held = (i if edge else first), around
            words += n
            if link >= 0:
                link_words[link] += n
            edge = edge and not n
            continue
        if name in BLOCKS:
            end(i)
            edge = True
        for _, before in elements.step(kind, name):
            around, link = before
        if kind == "open" and name not in VOID:
            elements.push(name, (around, link))
            if name == "a":
                link = i
            elif name in BLOCKS:
                held_by = around[3] if name in PARAGRAPHS or name in LISTS else i
                around = (key, name, i, held_by)
    end(len(found))
    return out


def count_tags(page: str) -> dict[str, list[int]] | None:
    """How often each tag key, each word as key ``""``, and each word of a kind of block as
    key ``@kind`` stands inside and outside the page's content element; None for a page
    without exactly one."""
    found = list(tokens(page))
    marks = [i for i, (_, name, *_) in enumerate(found) if name in CONTENT]
    if len(marks) != 2 or found[marks[0]][0] != "open" or found[marks[1]][0] != "close":
        return None
    elements = _Open()
    for i, (kind, name, *_) in enumerate(found[: marks[0]]):
        if kind != "text":
            elements.step(kind, name)
        if kind == "open" and name not in VOID:
            elements.push(name, i)
    around = {i for _, i in elements.stack}  # what stands around the mark tells nothing of its sides
    counts: dict[str, list[int]] = {}
    for i, (kind, name, key, _) in enumerate(found):
        if name in CONTENT or i in around:
            continue
        side = 0 if marks[0] < i < marks[1] else 1
        n = len(key.split()) if kind == "text" else 1
        counts.setdefault("" if kind == "text" else key, [0, 0])[side] += n
    for block in blocks_of(found, [True] * len(found)):
        if block.inside not in around or block.name in PARAGRAPHS:
            side = 0 if marks[0] < block.first < marks[1] else 1
            counts.setdefault("@" + block.kind, [0, 0])[side] += block.words
    return counts


def learn(counts: dict[str, tuple[int, int]]) -> Weights:
    """Weights from the summed counts of labelled pages; the defaults without any."""
    if not counts:
        return Weights()

    def log_odds(key: str) -> float:
        inside, outside = counts[key]
        return math.log((inside + 0.5) / (outside + 0.5))

    word = max(log_odds(""), 0.5) if "" in counts else Weights.word
    floor = -TAG_FLOOR * word
    tags = {k: max(min(log_odds(k), -0.1), floor) for k in counts if k and k[0] != "@"}
    never = {k for k in tags if "." in k and counts[k][0] == 0 and counts[k][1] >= 20}
    kinds = {
        k[1:]: max(-1.0, min(log_odds(k) / 2, 1.0))
        for k in counts
        if k[:1] == "@" and sum(counts[k]) >= LEAST_SEEN
    }
    return Weights(
        word=word, tags=tags, other=max(Weights.other, floor), boilerplate=frozenset(never), kinds=kinds
    )


def score_block(block: Block, weights: Weights) -> float:
    """What the words of a block count for a region, or against it, and then ``MOST`` words
    at most. The kind tells it where labelled pages hold such blocks; otherwise short links
    count against, words of paragraphs for, and other words if they are ``LEAST_WORDS``."""
    link = " a" if block.kind.endswith(" a") else ""
    share = weights.kinds.get(block.kind, weights.kinds.get(block.name + link))
    if share is not None:
        words = share * (block.words if share > 0 else min(block.words, MOST))
    elif link:
        words = -min(block.words, MOST)
    else:
        words = block.words - (0 if block.name in PARAGRAPHS else LEAST_WORDS)
    return weights.word * words


def best_range(scores: list[float]) -> tuple[int, int]:
    """The contiguous range of the highest total, the first of equal ones; an empty one
    where no total is positive."""
    best = run = 0.0
    best_from = best_to = run_from = 0
    for i, score in enumerate(scores):
        run += score
        if run <= 0:
            run, run_from = 0.0, i + 1
        elif run > best:
            best, best_from, best_to = run, run_from, i + 1
    return best_from, best_to


def _region(found: list[tuple], blocks: list[Block], outside: list[bool], weights: Weights) -> tuple[int, int]:
    """First and last of the blocks that are content, as a range."""
    # Each block with the tags inside it is one element of the scan, each tag between blocks too.
    scores, at, places = [], 0, []
    for block in blocks:
        own = score_block(block, weights)
        for i in range(at, block.last):
            kind, _, key, _ = found[i]
            if kind != "text" and not outside[i]:
                cost = weights.tags.get(key, weights.other)
                if i < block.first:
                    scores.append(cost)
                else:
                    own += cost
        places.append(len(scores))
        scores.append(own)
        at = block.last
    start, end = best_range(scores)
    if start == end:  # no paragraph and no long text: any words that are no links
        plain = [0.0 if b.kind.endswith(" a") else float(b.words) for b in blocks]
        return best_range(plain)
    first, last = bisect_left(places, start), bisect_left(places, end)
    # The region is completed by what stands next to it in its own element.
    element = blocks[last - 1].inside
    if element >= 0 and found[element][1] != "body":
        while last < len(blocks) and blocks[last].inside == element:
            last += 1
    element = blocks[first].inside
    if element >= 0 and found[element][1] != "body":
        while first and blocks[first - 1].inside == element:
            first -= 1
    return first, last


def extract(page: str | None, weights: Weights = Weights()) -> str:
    """The main text of a page: its blocks in page order, one to a line; empty for a
    null or empty page and for a page whose words are all in boilerplate tags or links."""
    if not page:
        return ""
    found = list(tokens(page))
    outside = _outside(found, weights)
    blocks = blocks_of(found, [not o for o in outside])
    first, last = _region(found, blocks, outside, weights)
    if first == last:
        return ""
    lines, line = [], []
    for i in range(blocks[first].first, blocks[last - 1].last):
        kind, name, key, _ = found[i]
        if kind != "text" and name in BLOCKS:
            lines.append(line)
            line = []
        elif not outside[i]:
            line.append(key if kind == "text" else " " if name == "br" else "")
    joined = (" ".join(html.unescape("".join(line)).split()) for line in [*lines, line])
    return "\n".join(line for line in joined if line)


def fit(pages: DataFrame, labelled: int = LABELLED_PAGES) -> Weights:
    """Weights from at most ``labelled`` pages, those whose page_id has the smallest
    hash; what comes to the driver are the tag counts of this sample."""
    chosen = (
        pages.where("page_id is not null and html is not null")
        .where(F.lower("html").rlike("<(article|main)[ >]"))
        .select("page_id")
        .orderBy(F.xxhash64("page_id"), "page_id")
        .limit(labelled)
        .distinct()
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *v) for page in batch["html"] for k, v in (count_tags(page) or {}).items()]
            yield pd.DataFrame(rows, columns=["key", "inside", "outside"])

    counts = (
        pages.where("html is not null")
        .select("page_id", "html")
        .join(chosen, "page_id")
        .select("html")
        .mapInPandas(run, "key string, inside long, outside long")
        .groupBy("key")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    )
    return learn({r["key"]: (r["inside"], r["outside"]) for r in counts.collect()})


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``, a row per row of ``pages(page_id, url, html)``.

    Character references are decoded, white space inside a block becomes one space,
    blocks are joined by one newline. A null or empty page has an empty text. Equal
    rows get equal results, null ids and urls are passed through, and an empty table
    gives an empty result. Without ``weights`` they are learned from ``pages``.
    """
    weights = fit(pages) if weights is None else weights

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(page, weights) for page in batch], dtype=object)

    rows = pages.select("page_id", "url", text_of("html").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
