"""Template work on page one: classify, zones, matches, fields, confidence.

The templates are literals of the plan, so every operator here is one narrow
projection over the document rows. A document is never copied per template,
zone or pattern and nothing is shuffled; what leaves an operator as rows is
exploded from results, after the text has been dropped.

Expressions that repeat per pattern are written as SQL text, which is parsed in
one step; a set of templates makes thousands of nodes.
"""

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from foliomine.functions.text import clean_field, pattern
from foliomine.operators import needles
from foliomine.sources.pages import PlainLayout
from foliomine.sources.templates import BUILTIN_TEMPLATES, Template, Zone

_MATCHES = "array<struct<pattern_no:int,ord:int,groups:array<string>,text:string>>"


def rows_of(documents: DataFrame, generator: Column, named: str, *kept: str) -> DataFrame:
    """Rows of a generator, with the document's id and the ``kept`` columns.

    The generator is an ``_outer`` one, and the rows it makes for documents
    without an element are removed by ``named`` after it. For a plain generator
    over a computed column Spark infers a filter on the array's size and pushes
    it below the projection that computes the array, which runs it twice.
    """
    return documents.select("doc_id", *kept, generator).where(F.col(named).isNotNull())


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _find_all(text: str, regex: str, group: int = 0, multiline: bool = True) -> str:
    p = pattern(regex, ignore_case=True, multiline=multiline)
    return f"regexp_extract_all({text}, {_literal(p)}, {group})"


def _count(text: str, regex: str, multiline: bool = True) -> str:
    p = pattern(regex, ignore_case=True, multiline=multiline)
    return f"regexp_count({text}, {_literal(p)})"


def _by_type(templates: list[Template], value: Callable[[Template], str]) -> Column:
    """``value`` of the document's own template; the other branches are not run."""
    if not templates:
        return F.lit(None)
    cases = " ".join(f"WHEN {_literal(t.name)} THEN {value(t)}" for t in templates)
    return F.expr(f"CASE doc_type {cases} END")


def identifier_score(text: str, template: Template) -> Column:
    """Matches of all identifier patterns of one template in column ``text``."""
    counts = [_count(text, p, multiline=False) for p in template.identifiers]
    return F.expr(" + ".join(counts) or "0")


def _either(templates: list[Template]) -> str | None:
    """A pattern that finds a match where any identifier has one, so that a text without any is
    searched once. None where there is no such pattern: for a template without identifiers,
    or groups that are named or referred to by number."""
    identifiers = [p for t in templates for p in t.identifiers]
    if not identifiers or not all(t.identifiers for t in templates):
        return None
    if any(re.search(r"\\[1-9k]|\\[QE]|\(\?[^:=!>]|\(\?<", p) for p in identifiers):
        return None
    any_of = "|".join(f"(?:{p})" for p in identifiers)
    # Where all begin with two plain letters and have no other branch, these are looked at first.
    if all(re.match(r"[A-Za-z]{2}(?![?*+{])[^|]*$", p) for p in identifiers):
        first, second = ("".join(sorted({p[i].lower() for p in identifiers})) for i in (0, 1))
        any_of = f"(?=[{first}][{second}])(?:{any_of})"
    return pattern(any_of, ignore_case=True)


def classify(
    documents: DataFrame,
    templates: list[Template] = BUILTIN_TEMPLATES,
    text: str = "page_text",
) -> DataFrame:
    """Add ``doc_type`` and ``score``: most matches win, ties go to the earlier
    template, no match at all leaves ``doc_type`` NULL."""
    none = lambda score: F.struct(F.lit(score).alias("score"), F.lit(0).alias("rank"), F.lit("").alias("name"))
    scored = F.greatest(
        *[
            F.struct(
                identifier_score(text, t).alias("score"),
                F.lit(-no).alias("rank"),
                F.lit(t.name).alias("name"),
            )
            for no, t in enumerate(templates)
        ],
        none(-1),
    )
    if (either := _either(templates)) is not None:
        scored = F.when(~F.col(text).rlike(either), none(0)).otherwise(scored)
    return documents.withColumn("_best", scored).select(
        *documents.columns,
        F.when(F.col("_best.score") > 0, F.col("_best.name")).alias("doc_type"),
        F.col("_best.score").alias("score"),
    )


def scores(
    documents: DataFrame,
    templates: list[Template] = BUILTIN_TEMPLATES,
    text: str = "page_text",
) -> DataFrame:
    """``(doc_id, template, score)`` rows, one per document and template."""
    per_template = F.array(
        *[
            F.struct(
                F.lit(t.name).alias("template"),
                identifier_score(text, t).alias("score"),
            )
            for t in templates
        ]
    )
    return documents.select("doc_id", F.inline(per_template))


_BREAK = "\x00"
_QUANTIFIER = r"(?:[?*+]|\{[^}]*\})*"
# What of a pattern is no plain text, each taken out with its quantifier, in this order.
_NOT_PLAIN = [
    r"\\(?:[pP]\{[^}]*\}|[pP].|x\{[^}]*\}|x..|u....|N\{[^}]*\}|c.|0[0-7]{1,3}|k<[^>]*>|[0-9]+|.)" + _QUANTIFIER,
    r"\[[^\[\]]*\]" + _QUANTIFIER,
    *[r"\([^()]*\)" + _QUANTIFIER] * 4,
    r".(?:[?*+]|\{[^}]*\})+",
    r"[.^$]",
]


def required_pieces(regex: Column) -> Column:
    """Strings, folded, that every text matched by the pattern holds; none for a pattern with
    alternatives outside of groups, inline flags, or a form that is not understood. They may
    be fewer than a text has to hold, never more."""
    plain = regex
    for part in _NOT_PLAIN:
        plain = F.regexp_replace(plain, "(?s)" + part, _BREAK)
    understood = ~regex.rlike(r"\(\?[a-zA-Z-]+[):]") & ~plain.rlike(r"[|()\[\]{}\\]")
    pieces = F.filter(F.split(needles.fold(plain), _BREAK), lambda p: p != "")
    return F.when(understood, pieces).otherwise(F.array().cast("array<string>"))


def _matched(texts: DataFrame, patterns: DataFrame, block: int = 64) -> DataFrame:
    """``(text_id, pattern, n)`` of the patterns that match ``texts(text_id, text)``, with
    the number of matches. Patterns with a required string are tried on texts that have
    its rarest gram. The others have to be tried on every text: they are a list that goes
    over all rows in blocks."""
    with_pieces = patterns.select("pattern", required_pieces(F.col("pattern")).alias("pieces"))
    indexed = with_pieces.where(F.size("pieces") > 0).select(F.col("pattern").alias("needle"), "pieces")
    folded = texts.select("text_id", needles.fold(F.col("text")).alias("text"), F.col("text").alias("_whole"))
    tried = needles.candidates(folded, indexed).select(
        "text_id", F.col("_whole").alias("text"), F.col("needle").alias("pattern")
    )
    plain = with_pieces.where(F.size("pieces") == 0).select("pattern")
    n_blocks = -(-plain.count() // block)
    if n_blocks:
        spread = F.pmod(F.xxhash64("pattern"), F.lit(n_blocks)).alias("block")
        blocks = plain.groupBy(spread).agg(F.collect_list("pattern").alias("patterns"))
        dealt = texts.select("*", F.explode(F.sequence(*(F.lit(n).cast("bigint") for n in (0, n_blocks - 1)))).alias("block"))
        rest = dealt.join(blocks, "block").select("text_id", "text", F.explode("patterns").alias("pattern"))
        tried = tried.unionByName(rest)
    n = F.call_function("regexp_count", F.col("text"), F.concat(F.lit(pattern("", ignore_case=True)), "pattern"))
    return tried.select("text_id", "pattern", n.alias("n")).where("n > 0")


def classify_from(documents: DataFrame, table: DataFrame, text: str = "page_text") -> DataFrame:
    """As :func:`classify`, with templates from a table of any size in the layout of
    :func:`foliomine.sources.templates.template_rows`. Document ids are unique."""
    identifiers = table.select("template_no", "name", F.explode("identifiers").alias("pattern"))
    texts = documents.select(F.col("doc_id").alias("text_id"), F.col(text).alias("text"))
    matched = _matched(texts, identifiers.select("pattern").distinct())
    scored = (
        matched.join(identifiers, "pattern")
        .groupBy("text_id", "template_no", "name")
        .agg(F.sum("n").cast("int").alias("score"))
    )
    best = scored.groupBy("text_id").agg(
        F.max(F.struct("score", -F.col("template_no"), "name")).alias("_best")
    )
    joined = documents.join(best, documents["doc_id"] == best["text_id"], "left")
    return joined.select(
        *[documents[c] for c in documents.columns],
        best["_best"]["name"].alias("doc_type"),
        F.coalesce(best["_best"]["score"], F.when(documents[text].isNull(), -1).otherwise(0)).alias("score"),
    )


def fields_from(documents: DataFrame, table: DataFrame, text: str = "text") -> DataFrame:
    """``documents(doc_id, doc_type, ...)`` with ``fields`` as :func:`fields` gives them, the
    patterns being those of the row's template in the table, the first of its name: a template
    comes to its documents as one row, and its patterns are tried inside the document's row."""
    first = table.groupBy(F.col("name").alias("_name")).agg(F.min(F.struct("template_no", "fields")).alias("_first"))
    patterns = first.select("_name", F.col("_first.fields").alias("_patterns"))

    def last(pattern_of: Column) -> Column:
        regex = F.concat(F.lit(pattern("", ignore_case=True, multiline=True)), pattern_of)
        return F.try_element_at(F.regexp_extract_all(F.col(text), regex, F.lit(1)), F.lit(-1))

    joined = documents.join(patterns, documents["doc_type"] == F.col("_name"), "left")
    raw = F.transform("_patterns", lambda f: F.struct(f["key"].alias("key"), last(f["pattern"]).alias("raw")))
    found = F.transform(
        F.filter(raw, lambda f: f["raw"].isNotNull()),
        lambda f: F.struct(f["key"].alias("key"), clean_field(f["key"], f["raw"]).alias("value")),
    )
    return joined.select(*[documents[c] for c in documents.columns], found.alias("fields"))


def fields(text: str, templates: list[Template] = BUILTIN_TEMPLATES) -> Column:
    """``array<struct<key, value>>`` of the fields found in column ``text`` for
    the row's ``doc_type``: last match per field, values in their standard form,
    in template order."""

    def of(template: Template) -> str:
        raw = [
            f"named_struct('key', {_literal(key)}, 'raw',"
            f" try_element_at({_find_all(text, regex, 1)}, -1))"
            for key, regex in template.fields.items()
        ]
        return f"filter(array({', '.join(raw)}), f -> f.raw IS NOT NULL)"

    return F.transform(
        _by_type([t for t in templates if t.fields], of),
        lambda f: F.struct(
            f["key"].alias("key"), clean_field(f["key"], f["raw"]).alias("value")
        ),
    )


def field_rows(documents: DataFrame, fields: str = "fields") -> DataFrame:
    """``(doc_id, key, value, value_num, value_date)`` of a fields column."""
    key, value = F.col("key"), F.col("value")
    is_amount = key.rlike("amount|balance|total")
    return rows_of(documents, F.inline_outer(fields), "key").select(
        "doc_id",
        "key",
        "value",
        F.when(is_amount, value.try_cast("double")).alias("value_num"),
        F.when(~is_amount & key.rlike("date|period"), F.try_to_date(value, "yyyy-MM-dd")).alias(
            "value_date"
        ),
    )


def absolute_bounds(zone: Zone, width: str, height: str) -> list[str]:
    """The zone's rectangle (x1, y1, x2, y2) on a page of the given size."""
    x1, y1, x2, y2 = (float(b) for b in zone.bounds)
    return [f"{x1}D * {width}", f"{y1}D * {height}", f"{x2}D * {width}", f"{y2}D * {height}"]


def zone_text(words: str, zone: Zone, width: str = "1.0D", height: str = "1.0D") -> str:
    """SQL for the text of the words whose box overlaps the zone, in reading
    order: words set apart by a space, lines by a newline."""
    x1, y1, x2, y2 = absolute_bounds(zone, width, height)
    inside = (
        f"filter({words}, w -> w.x0 < {x2} AND w.x1 > {x1} AND w.top < {y2} AND w.bottom > {y1})"
    )
    # Each word brings the separator that stands before it. The array in the
    # array names the words inside, so they are found once.
    before = (
        "CASE WHEN i = 0 THEN '' WHEN get(inside, i - 1).line_no = w.line_no THEN ' '"
        " ELSE '\\n' END"
    )
    return (
        f"get(transform(array({inside}), inside ->"
        f" array_join(transform(inside, (w, i) -> concat({before}, w.text)), '')), 0)"
    )


def zone_lines(lines: str, zone: Zone, width: str = "1.0D", height: str = "1.0D") -> str:
    """As :func:`zone_text`, from a plain text's lines: line i of n is i/n down, word j of m is
    j/m across, and lines are words set apart by one space."""
    x1, y1, x2, y2 = absolute_bounds(zone, width, height)
    high = f"i / size({lines}) < {y2} AND (i + 1) / size({lines}) > {y1}"
    if width == "1.0D" and zone.bounds[0] <= 0 and zone.bounds[2] >= 1:
        return f"array_join(filter({lines}, (l, i) -> l <> '' AND {high}), '\\n')"
    wide = f"j / size(ws) < {x2} AND (j + 1) / size(ws) > {x1}"
    part = f"get(transform(array(split(l, ' ')), ws -> array_join(filter(ws, (w, j) -> {wide}), ' ')), 0)"
    cut = f"transform({lines}, (l, i) -> CASE WHEN l <> '' AND {high} THEN {part} ELSE '' END)"
    return f"array_join(filter({cut}, l -> l <> ''), '\\n')"


def zone_matches(text: str, zone: Zone) -> str:
    """SQL for all matches of the zone's patterns: pattern by pattern, in text
    order. A group that took no part in a match is NULL."""

    def of(pattern_no: int, regex: str) -> str:
        numbers = range(re.compile(regex).groups + 1)
        found = ", ".join(_find_all(text, regex, g) for g in numbers)
        groups = ", ".join(f"nullif(m.`{g}`, '')" for g in numbers[1:])
        return (
            f"transform(arrays_zip({found}), (m, i) -> named_struct('pattern_no', {pattern_no},"
            f" 'ord', i, 'groups', CAST(array({groups}) AS array<string>), 'text', m.`0`))"
        )

    found = ", ".join(of(no, regex) for no, regex in enumerate(zone.patterns))
    return f"CAST(concat({found or 'array()'}) AS {_MATCHES})"


def with_zones(
    documents: DataFrame,
    templates: list[Template] = BUILTIN_TEMPLATES,
    words: str = "words",
    width: str = "1.0D",
    height: str = "1.0D",
    counted: bool = False,
) -> DataFrame:
    """Replace ``words`` by ``zones``: per zone of the document's type its text
    and matches. Documents without a type get NULL. ``words`` is a column or
    SQL for one, which then runs only for documents that have a type; of a plain text's
    layout the zones are cut from its lines. ``width`` and ``height`` are SQL for the page
    size the boxes refer to. ``counted`` gives the number of a zone's matches, ``n_matches``,
    in place of the matches, for which each pattern searches a zone once per group."""
    zoned = [t for t in templates if t.zones]

    def texts(template: Template) -> str:
        if isinstance(words, PlainLayout):
            every = ", ".join(zone_lines("ls", z, width, height) for z in template.zones)
            return f"get(transform(array({words.lines}), ls -> array({every})), 0)"
        every = ", ".join(zone_text("ws", z, width, height) for z in template.zones)
        return f"get(transform(array({words}), ws -> array({every})), 0)"

    def matched(text: str, zone: Zone) -> str:
        if counted:
            return f"'n_matches', {' + '.join(_count(text, p) for p in zone.patterns) or '0'}"
        return f"'matches', {zone_matches(text, zone)}"

    def result(no: int, zone: Zone) -> str:
        text = f"get(_texts, {no})"
        return (
            f"named_struct('zone', {_literal(zone.name)}, 'zone_no', {no},"
            f" 'content_type', {_literal(zone.content_type)}, 'required', {zone.required},"
            f" 'n_patterns', {len(zone.patterns)}, 'text', {text}, {matched(text, zone)})"
        )

    def results(template: Template) -> str:
        return f"array({', '.join(result(no, z) for no, z in enumerate(template.zones))})"

    kept = [c for c in documents.columns if c != "words"]
    return documents.select(*kept, _by_type(zoned, texts).alias("_texts")).select(
        *kept, _by_type(zoned, results).alias("zones")
    )


def zone_rows(documents: DataFrame) -> DataFrame:
    """``(doc_id, doc_type, zone, zone_no, text)``."""
    return rows_of(documents, F.inline_outer("zones"), "zone", "doc_type").select(
        "doc_id", "doc_type", "zone", "zone_no", "text"
    )


def match_rows(documents: DataFrame) -> DataFrame:
    """``(doc_id, doc_type, zone, pattern_no, ord, groups, text)``."""
    found = F.transform(
        "zones",
        lambda z: F.transform(
            z["matches"],
            lambda m: F.struct(
                z["zone"].alias("zone"),
                m["pattern_no"].alias("pattern_no"),
                m["ord"].alias("ord"),
                m["groups"].alias("groups"),
                m["text"].alias("text"),
            ),
        ),
    )
    return rows_of(documents, F.inline_outer(F.flatten(found)), "zone", "doc_type")


def confidence(zones: Column, counted: bool = False) -> Column:
    """Mean over the required zones of matches per pattern. A zone without a
    match counts as zero; many matches of one pattern may lift it above one. The matches
    are ``counted`` where :func:`with_zones` did so."""
    n_matches = lambda z: z["n_matches"] if counted else F.size(z["matches"])
    required = F.filter(zones, lambda z: z["required"])
    total = F.aggregate(
        required,
        F.lit(0.0),
        lambda acc, z: acc
        + F.when(z["n_patterns"] > 0, n_matches(z) / z["n_patterns"]).otherwise(0.0),
    )
    return F.when(F.size(required) > 0, total / F.size(required)).when(zones.isNotNull(), 0.0)


def joined_zone_text(zones: Column) -> Column:
    """Non-empty zones in template order, each under its ``[name]``."""
    headed = F.transform(
        F.filter(zones, lambda z: z["text"] != ""),
        lambda z: F.concat(F.lit("["), z["zone"], F.lit("]\n"), z["text"]),
    )
    return F.array_join(headed, "\n\n")
