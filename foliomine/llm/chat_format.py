"""Chat formatting with a round trip through the grammar of the format.

A formatted conversation is a sequence of turns::

    ### Role: text</turn>\\n

The parser cuts at every ``</turn>`` (with a newline behind it, if there is one), takes
the role up to the first ``: ``, allows no further ``### `` and resolves escapes. Each conversation is rendered, parsed again and compared
with its turns, first with no escapes, then with those turns escaped that do not come
back alone, last with every turn escaped, which always comes back: the escapes put a
backslash inside each control string and double each backslash, so an escaped text
holds no control string and each escape has one reading.

All steps are column expressions on one row per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Control strings of the format with what stands for them inside an escaped text.
END = "</turn>"
HEAD = "### "
COLON = ": "
ESCAPES = ((END, "<\\/turn>"), (HEAD, "#\\## "))
ROLE_ESCAPES = (*ESCAPES, (COLON, ":\\ "))
LEARNED_ROLE = "assistant"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, controls=ESCAPES) -> Column:
    text = _replace(text, "\\", "\\\\")
    for control, stand_in in controls:
        text = _replace(text, control, stand_in)
    return text


def unescape(text: Column, controls=ESCAPES) -> Column:
    for control, stand_in in reversed(controls):
        text = _replace(text, stand_in, control)
    return _replace(text, "\\\\", "\\")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(COLON), text, F.lit(END + "\n"))


def render(turns: Column, escaped) -> Column:
    """One text of ``turns array<struct<role, text>>``; ``escaped`` tells of a turn
    whether it is escaped."""

    def one(turn: Column) -> Column:
        plain = _turn(turn["role"], turn["text"])
        safe = _turn(escape(turn["role"], ROLE_ESCAPES), escape(turn["text"]))
        return F.when(escaped(turn), safe).otherwise(plain)

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation. A piece that is no
    turn has a null role."""
    pieces = F.split(formatted, END + "\n?")
    # What follows the last mark is no turn; an intact conversation has nothing there.
    pieces = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)

    def one(piece: Column) -> Column:
        colon = F.locate(COLON, piece)
        well_formed = piece.startswith(HEAD) & (colon > 0) & (F.instr(F.substr(piece, F.lit(2)), HEAD) == 0)
        role = F.substring(piece, len(HEAD) + 1, colon - len(HEAD) - 1)
        text = F.substring(piece, colon + len(COLON), F.length(piece))
        return F.struct(
            F.when(well_formed, unescape(role, ROLE_ESCAPES)).alias("role"),
            unescape(text).alias("text"),
        )

    return F.transform(pieces, one)


def _gathered(conversations: DataFrame) -> DataFrame:
    """A row per conversation with its turns in order."""
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select("conv_id", plain.alias("turns"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns, formatted, level``, a row per conversation.

    Uses ``conv_id, turn, role, text``. Turns are ordered by ``turn`` (a null one
    first), of equal ones by role and text; repeated rows stay. A null role or text
    is empty. Rows without conv_id form one conversation, whose conv_id stays null.
    ``formatted`` holds the conversation, ``level`` how much was escaped: 0 nothing,
    1 the turns in conflict, 2 every turn. An empty table gives an empty result.
    """
    rows = _gathered(conversations)
    turns = F.col("turns")

    def conflicts(turn: Column) -> Column:
        alone = F.array(turn)
        return ~parse(render(alone, lambda _: F.lit(False))).eqNullSafe(alone)

    attempts = [lambda _: F.lit(False), conflicts, lambda _: F.lit(True)]
    rows = rows.withColumn("formatted", render(turns, attempts[0]))
    rows = rows.withColumn("level", F.when(parse(F.col("formatted")).eqNullSafe(turns), 0).otherwise(1))
    for level in (1, 2):
        again = render(turns, attempts[level])
        rows = rows.withColumn("formatted", F.when(F.col("level") == level, again).otherwise(F.col("formatted")))
        if level == 1:
            failed = (F.col("level") == 1) & ~parse(F.col("formatted")).eqNullSafe(turns)
            rows = rows.withColumn("level", F.when(failed, 2).otherwise(F.col("level")))
    return rows


def loss_spans(parsed: Column) -> Column:
    """Texts under the loss mask: those of the assistant's turns, in order."""
    learned = F.filter(parsed, lambda t: t["role"] == LEARNED_ROLE)
    return F.transform(learned, lambda t: t["text"])


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from ``formatted``."""
    rows = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("parsed"))
    rows = rows.withColumn("loss", F.array_join(loss_spans(F.col("parsed")), ""))
    said = F.array_join(
        F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return rows.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
