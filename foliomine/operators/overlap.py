"""Words and zones as tables of any size, joined where their boxes overlap.

Pages are laid out on a grid. Each box, of a word or of a zone, is listed under the cells
that it touches, and boxes that share a cell are compared exactly. So a word meets
the zones of its neighbourhood and no others, by an equi join.
"""

from pyspark.sql import Column, DataFrame, functions as F

CELLS = 8  # a side
WORD_BOX = ("x0", "top", "x1", "bottom")
ZONE_BOX = ("zone_x0", "zone_top", "zone_x1", "zone_bottom")


def zone_boxes(table: DataFrame) -> DataFrame:
    """``(doc_type, zone, zone_no, zone_x0, zone_top, zone_x1, zone_bottom)`` of templates in
    the layout of :func:`foliomine.sources.templates.template_rows`."""
    zones = table.select(F.col("name").alias("doc_type"), F.posexplode("zones").alias("zone_no", "z"))
    bounds = [F.col("z.bounds")[i].alias(c) for i, c in enumerate(ZONE_BOX)]
    return zones.select("doc_type", F.col("z.name").alias("zone"), "zone_no", *bounds)


def _cell(relative: Column) -> Column:
    """The cell of a position; those beyond the page belong to the outermost cells. So two
    overlapping boxes share a cell wherever they lie, and none has more than all cells."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(CELLS - 1.0), relative * CELLS))).cast("int")


def _in_cells(rows: DataFrame, box: tuple[str, ...], prefix: str) -> DataFrame:
    """Each row once per cell that its box touches, with the box's first column and line of
    cells. Rows without a whole box have no cell and are left out."""
    x0, y0, x1, y1 = (_cell(F.col(c)) for c in box)
    whole = rows.where(F.concat(*(F.col(c).cast("string") for c in box)).isNotNull())
    first = whole.select(
        "*",
        F.least(x0, x1).alias(f"{prefix}_first_x"),
        F.least(y0, y1).alias(f"{prefix}_first_y"),
        F.sequence(F.least(y0, y1), F.greatest(y0, y1)).alias("_ys"),
        F.explode(F.sequence(F.least(x0, x1), F.greatest(x0, x1))).alias("cell_x"),
    )
    return first.select("*", F.explode("_ys").alias("cell_y")).drop("_ys")


def overlaps(words: DataFrame, zones: DataFrame) -> DataFrame:
    """Words, with their columns, and the zones of their ``doc_type`` that they overlap, each
    pair once: in the first of the cells that both touch. Boxes that only touch don't overlap."""
    met = _in_cells(words, WORD_BOX, "word").join(
        _in_cells(zones, ZONE_BOX, "zone"), ["doc_type", "cell_x", "cell_y"]
    )
    first = (F.col("cell_x") == F.greatest("word_first_x", "zone_first_x")) & (
        F.col("cell_y") == F.greatest("word_first_y", "zone_first_y")
    )
    x0, y0, x1, y1 = (F.col(c) for c in WORD_BOX)
    zx0, zy0, zx1, zy1 = (F.col(c) for c in ZONE_BOX)
    exact = (x0 < zx1) & (x1 > zx0) & (y0 < zy1) & (y1 > zy0)
    kept = [*words.columns, "zone", "zone_no"]
    return met.where(first & exact).select(*kept)


def zone_texts(types: DataFrame, words: DataFrame, zones: DataFrame) -> DataFrame:
    """``(doc_id, doc_type, zone, zone_no, text)`` for every zone of each document's type.

    ``types(doc_id, doc_type)`` has one row per document; ``words(doc_id, line_no, word_no,
    text, x0, top, x1, bottom)`` are those of page one, boxes relative to the page; ``zones``
    is as :func:`zone_boxes` gives it. The text is the zone's words in reading order, set apart
    by a space, lines by a newline. A zone without words, also of a document without words,
    has an empty text; documents without a type, or of a type without zones, have no row.
    Words that repeat are there as often as they are delivered; those without text or without
    a whole box are left out. A group of the first aggregate is one zone of one page, one of
    the second the texts of a page. Words move by document once, and not at all where they lie
    so already; zones small enough for a broadcast come to them, and texts stay there.
    """
    fields = ["doc_id", "line_no", "word_no", "text", *WORD_BOX]
    typed = words.select(*fields).where("text is not null").join(types.select("doc_id", "doc_type"), "doc_id")
    # Words alike in these three are alike in the text, whatever their boxes.
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "word_no", "text")))
    inside = overlaps(typed, zones).groupBy("doc_id", "zone_no").agg(ordered.alias("words"))

    def before(word: Column, i: Column) -> Column:
        same = F.get("words", i - 1)["line_no"] == word["line_no"]
        return F.when(i == 0, "").when(same, " ").otherwise("\n")

    text = F.array_join(F.transform("words", lambda w, i: F.concat(before(w, i), w["text"])), "")
    by_zone = F.map_from_entries(F.collect_list(F.struct("zone_no", text.alias("text"))))
    texts = inside.groupBy("doc_id").agg(by_zone.alias("texts"))
    every = types.select("doc_id", "doc_type").join(zones.select("doc_type", "zone", "zone_no"), "doc_type")
    found = F.try_element_at("texts", F.col("zone_no"))
    return every.join(texts, "doc_id", "left").select(
        "doc_id", "doc_type", "zone", "zone_no", F.coalesce(found, F.lit("")).alias("text")
    )
