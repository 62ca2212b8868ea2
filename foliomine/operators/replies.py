"""The AI step as tables: requests go out, replies come back, both are rows."""

from pyspark.sql import Column, DataFrame, functions as F

from foliomine.functions.entities import empty_strings
from foliomine.schema import AI_REPLY, AI_STATEMENT_REPLY

# Request parameters, reply defaults and the texts of failures.
MODEL = "gpt-3.5-turbo"
TEMPERATURE = 0.3
INPUT_LIMIT = 4000
UNKNOWN_TYPE = "unknown"
PARSE_FAILED = "Failed to parse AI response"
NOT_AN_OBJECT = "Failed to process AI response"
REPLY_ERROR = "AIProcessingError"
HINT_REPLY = "AI processing failed to parse the document"
HINT_QUOTA = (
    "Please check your OpenAI API quota and billing status at "
    "https://platform.openai.com/account/billing"
)
HINT_OTHER = "An unexpected error occurred during AI processing"

SYSTEM_TEXT = (
    "Read the document and answer with one JSON object. Use the keys document_type, "
    "metadata, text, key_value_pairs, people, organizations, dates and amounts. "
    "Write amounts as decimal numbers."
)


def requests(
    documents: DataFrame, text: str = "text", system_text: str = SYSTEM_TEXT
) -> DataFrame:
    """Requests ``(doc_id, chunk_no, n_chunks, ...)`` of every document that has text:
    model, both messages, parameters. The service takes ``INPUT_LIMIT`` characters at a
    time, so a longer text goes out in chunks, none of it left out."""
    n_chunks = F.ceil(F.length(text) / INPUT_LIMIT).cast("int")
    chunks = documents.where(F.length(text) > 0).select(
        "doc_id",
        F.col(text).alias("_text"),
        n_chunks.alias("n_chunks"),
        F.explode(F.sequence(F.lit(1), n_chunks)).alias("chunk_no"),
    )
    start = (F.col("chunk_no") - 1) * INPUT_LIMIT + 1
    return chunks.select(
        "doc_id",
        "chunk_no",
        "n_chunks",
        F.lit(MODEL).alias("model"),
        F.lit(system_text).alias("system_text"),
        F.substr("_text", start, F.lit(INPUT_LIMIT)).alias("user_text"),
        F.lit(TEMPERATURE).alias("temperature"),
        F.lit("json_object").alias("response_format"),
    )


def _is_object(reply: Column) -> Column:
    return F.schema_of_variant(F.try_parse_json(reply)).startswith("OBJECT")


def reply_error(reply: Column) -> Column:
    """Why a reply cannot be used, NULL when it can."""
    return (
        F.when(F.try_parse_json(reply).isNull(), PARSE_FAILED)
        .when(~_is_object(reply), NOT_AN_OBJECT)
    )


def resolution_hint(message: Column) -> Column:
    """Advice for a failed call."""
    return F.when(F.lower(message).contains("quota"), HINT_QUOTA).otherwise(HINT_OTHER)


def normalise(replies: DataFrame) -> DataFrame:
    """``replies(doc_id, reply)`` with every field present, or ``error`` set."""
    no_pairs = F.create_map().cast("map<string,string>")
    parsed = replies.select(
        "*",
        reply_error(F.col("reply")).alias("error"),
        F.from_json("reply", AI_REPLY.replace("array<string>", "string")).alias("r"),
    )
    ok = F.col("error").isNull()

    def names(name: str) -> Column:
        """A list; a service that found one name may send it bare."""
        sent = F.col(f"r.{name}")
        return F.when(sent.startswith("["), F.from_json(sent, "array<string>")).when(
            sent != "", F.array(sent)
        )

    def field(name: str, default: Column, value: Column | None = None) -> Column:
        sent = F.col(f"r.{name}") if value is None else value
        return F.when(ok, F.coalesce(sent, default)).alias(name)

    return parsed.select(
        *replies.columns,
        "error",
        field("document_type", F.lit(UNKNOWN_TYPE)),
        field("metadata", no_pairs),
        field("text", F.lit("")),
        field("key_value_pairs", no_pairs),
        *[
            field(name, empty_strings(), names(name))
            for name in ("people", "organizations", "dates", "amounts")
        ],
    )


def _distinct_in_order(parts: Column, name: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: p[name])))


def _last_by_key(parts: Column, name: str) -> Column:
    """The entries of all parts as one map; of a repeated key the last one counts.

    Sorted by key and then from the last to the first, a kept entry is one whose key
    differs from that before it: the cost is that of sorting.
    """
    entries = F.flatten(F.transform(parts, lambda p: p[name]))
    ranked = F.array_sort(
        F.transform(
            entries,
            lambda e, i: F.struct(e["key"].alias("key"), (-i).alias("place"), e["value"].alias("value")),
        )
    )
    last = F.transform(
        F.array(ranked),
        lambda r: F.filter(r, lambda e, i: (i == 0) | (e["key"] != F.get(r, i - 1)["key"])),
    )[0]
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def merge(normalised: DataFrame, part: str = "chunk_no", separator: str = "") -> DataFrame:
    """One reply per document from those to its parts: ``(doc_id, error, <fields>,
    n_parts, n_failed)``.

    Parts are taken in the order of the column ``part``. The type is the first known one,
    texts that are not empty are joined by ``separator``, lists are united in the order of first appearance,
    of a map's repeated key the last value counts. Replies that could not be used are
    counted and left out; where none could, ``error`` is that of the first. Equal rows
    are one part, as when a request was sent again. A document's replies meet in one
    row, which holds its text in the result too.
    """
    maps, lists = ("metadata", "key_value_pairs"), ("people", "organizations", "dates", "amounts")
    row = F.struct(
        F.col(part).alias("part"),
        "error",
        "document_type",
        "text",
        *[F.map_entries(name).alias(name) for name in maps],
        *lists,
    )
    gathered = normalised.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.collect_list(row))).alias("parts"))
    sorted_parts = gathered.select(
        "doc_id",
        "parts",
        F.filter("parts", lambda p: p["error"].isNull()).alias("usable"),
    )
    usable, any_usable = F.col("usable"), F.size("usable") > 0
    known = F.filter(usable, lambda p: p["document_type"] != UNKNOWN_TYPE)
    written = F.filter(F.transform(usable, lambda p: p["text"]), lambda t: t != "")

    def field(name: str, value: Column) -> Column:
        return F.when(any_usable, value).alias(name)

    return sorted_parts.select(
        "doc_id",
        F.when(~any_usable, F.get("parts", F.lit(0))["error"]).alias("error"),
        field("document_type", F.coalesce(F.get(known, F.lit(0))["document_type"], F.lit(UNKNOWN_TYPE))),
        field("metadata", _last_by_key(usable, "metadata")),
        field("text", F.array_join(written, separator)),
        field("key_value_pairs", _last_by_key(usable, "key_value_pairs")),
        *[field(name, _distinct_in_order(usable, name)) for name in lists],
        F.size("parts").alias("n_parts"),
        (F.size("parts") - F.size("usable")).alias("n_failed"),
    )


def normalise_statement(replies: DataFrame) -> DataFrame:
    """Statement replies: ``account_info``, ``statement_details``, ``transactions``.
    Numbers may be sent as numbers or as text."""
    ok = reply_error(F.col("reply")).isNull()
    parsed = replies.select(
        "*",
        reply_error(F.col("reply")).alias("error"),
        F.from_json("reply", AI_STATEMENT_REPLY.replace("double", "string"))
        .try_cast(AI_STATEMENT_REPLY)
        .alias("r"),
    )
    no_transactions = F.array().cast(
        AI_STATEMENT_REPLY[AI_STATEMENT_REPLY.index("transactions:") + len("transactions:") : -1]
    )
    return parsed.select(
        *replies.columns,
        "error",
        F.when(ok, F.col("r.account_info")).alias("account_info"),
        F.when(ok, F.col("r.statement_details")).alias("statement_details"),
        F.when(ok, F.coalesce("r.transactions", no_transactions)).alias("transactions"),
    )


def statement_transactions(normalised: DataFrame) -> DataFrame:
    """``(doc_id, txn_no, date, ..., mandate)`` rows of statement replies."""
    rows = normalised.select("doc_id", F.posexplode_outer("transactions").alias("n", "t"))
    return rows.where(F.col("n").isNotNull()).select(
        "doc_id", (F.col("n") + 1).alias("txn_no"), "t.*"
    )
