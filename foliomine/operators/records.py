"""One typed record per document: AI reply, else template, else basic extraction."""

from pyspark.sql import Column, DataFrame, functions as F

from foliomine.functions import entities as en
from foliomine.operators import pairs, replies as rp, statements, tables as tb, templates as tp
from foliomine.schema import AI_REPLY, FALLBACK, STATEMENT_DETAILS, TABLE, TRANSACTION
from foliomine.sources.templates import BUILTIN_TEMPLATES, Template

# Fixed values of the processing column.
AI, TRADITIONAL = "ai", "traditional"
NO_CLIENT = "OpenAI client not configured"
NO_TEXT = "No text content available"
UNKNOWN = "unknown"
BANK_STATEMENT = "bank_statement"

REPLY_FIELDS = [
    "document_type", "metadata", "text", "key_value_pairs",
    "people", "organizations", "dates", "amounts",
]
_REPLY = AI_REPLY.replace("struct<", "struct<error:string,", 1)


def extract(
    documents: DataFrame, templates: list[Template] = BUILTIN_TEMPLATES, words: str = "words"
) -> DataFrame:
    """Template and basic extraction of ``documents(doc_id, text, page_text,
    words, ...)``, with ``tables`` (raw cells) where there are any. ``words``
    names the layout of page one or is SQL for it.

    A narrow projection per document: it adds ``doc_type``, ``confidence``,
    ``found_text``, ``found_tables``, ``pairs``, ``fields``, ``entities``,
    ``transactions``, ``statement_details`` and drops the working columns.
    """
    if "tables" not in documents.columns:
        documents = documents.withColumn("tables", F.array().cast("array<array<array<string>>>"))
    rest = F.substr("text", F.length("page_text") + 1)

    def later_pages(first: Column) -> Column:
        return F.when(F.length(rest) > 0, F.concat(first, rest)).otherwise(first)

    kept = [c for c in documents.columns if c not in ("page_text", "words", "tables", "text")]
    zoned = tp.with_zones(tp.classify(documents, templates), templates, words, counted=True)
    known = F.col("doc_type").isNotNull()
    is_statement = F.col("doc_type") == BANK_STATEMENT
    whole = F.coalesce("text", F.lit(""))  # all pages; type and zones are those of page one
    located = zoned.select(
        *kept,
        "text",
        "doc_type",
        tp.confidence(F.col("zones"), counted=True).alias("confidence"),
        F.when(known, later_pages(tp.joined_zone_text(F.col("zones"))))
        .otherwise(F.coalesce("text", F.lit("")))
        .alias("found_text"),
        F.coalesce(tb.normalise(F.col("tables")), F.array().cast(f"array<{TABLE}>")).alias(
            "found_tables"
        ),
    )
    return located.select(
        *kept,
        "text",
        "doc_type",
        "confidence",
        "found_text",
        "found_tables",
        F.when(known, pairs.pair_map(F.col("text")))
        .otherwise(_no_pairs())
        .alias("pairs"),
        F.when(known, F.map_from_entries(tp.fields("text", templates)))
        .otherwise(_no_pairs())
        .alias("fields"),
        en.entities(en.dates(whole), en.amounts(whole)).alias("entities"),
        F.when(is_statement, statements.transaction_array(F.col("text")))
        .otherwise(F.array().cast(f"array<{TRANSACTION}>"))
        .alias("transactions"),
        F.when(is_statement, statements.balances(F.col("text"))).alias("statement_details"),
    )


def _no_pairs() -> Column:
    return F.create_map().cast("map<string,string>")


def _reply_or(ai_value: Column, is_empty: Column, other: Column) -> Column:
    """A field of a usable reply, unless the reply leaves it empty."""
    return F.when(F.col("_ai") & ~is_empty, ai_value).otherwise(other)


def with_replies(documents: DataFrame, normalised_replies: DataFrame) -> DataFrame:
    """Add ``reply``, NULL where there is none. Replies to chunks (``chunk_no``) are
    merged first, so a document stays one row; other replies are at most one per document.

    Joined before :func:`extract`, the shuffle moves a document's text once and
    nothing that is extracted from it.
    """
    if "chunk_no" in normalised_replies.columns:
        normalised_replies = rp.merge(normalised_replies)
    reply = F.struct("error", *REPLY_FIELDS).alias("reply")
    return documents.join(normalised_replies.select("doc_id", reply), "doc_id", "left")


def assemble(extracted: DataFrame, processed_at: Column, version: str) -> DataFrame:
    """``(doc_id, record)`` from extracted documents, with or without ``reply``.

    Where a reply can be used, its fields replace the extracted ones it fills.
    Where it cannot, the record says why and keeps what was extracted. The time
    is a parameter, so a rerun writes the same records.
    """
    if "reply" not in extracted.columns:
        extracted = extracted.withColumn("reply", F.lit(None).cast(_REPLY))
    replied = F.col("reply").isNotNull() & (F.col("text") != "")
    joined = extracted.withColumn("_replied", F.coalesce(replied, F.lit(False))).withColumn(
        "_ai", F.col("_replied") & F.col("reply.error").isNull()
    )
    reply = {name: F.col(f"reply.{name}") for name in REPLY_FIELDS}

    def names_found(name: str) -> Column:
        return _reply_or(reply[name], F.size(reply[name]) == 0, F.col(f"entities.{name}")).alias(name)

    failed = F.col("_replied") & F.col("reply.error").isNotNull()
    purpose = F.coalesce(F.try_element_at(reply["metadata"], F.lit("purpose")), F.lit(""))
    record = F.struct(
        F.struct(
            F.col("checksum").alias("checksum"),
            processed_at.alias("processed_at"),
            F.lit(version).alias("version"),
        ).alias("catalog"),
        F.struct(F.col("path").alias("path"), F.col("modified_at").alias("modified_at")).alias("source"),
        F.struct(
            _reply_or(
                reply["document_type"],
                reply["document_type"] == UNKNOWN,
                F.coalesce("doc_type", F.lit(UNKNOWN)),
            ).alias("type"),
            F.when(F.col("_ai"), purpose).otherwise("").alias("purpose"),
            F.col("confidence").alias("confidence"),
            F.col("statement_details").cast(STATEMENT_DETAILS).alias("statement_details"),
        ).alias("doc_info"),
        F.struct(
            _reply_or(reply["text"], reply["text"] == "", F.col("found_text")).alias("text"),
            F.col("found_tables").alias("tables"),
            _reply_or(
                reply["key_value_pairs"], F.size(reply["key_value_pairs"]) == 0, F.col("pairs")
            ).alias("key_value_pairs"),
            F.struct(
                names_found("people"),
                names_found("organizations"),
                names_found("dates"),
                names_found("amounts"),
            ).alias("entities"),
            F.col("transactions").alias("transactions"),
        ).alias("content"),
        F.when(F.col("_ai") & (F.size(reply["metadata"]) > 0), reply["metadata"])
        .otherwise(F.col("fields"))
        .alias("fields"),
        F.struct(
            F.when(F.col("_ai"), AI).otherwise(TRADITIONAL).alias("method"),
            F.when(F.col("_ai"), "ai")
            .when(F.col("doc_type").isNotNull(), "template")
            .otherwise("basic")
            .alias("branch"),
            F.when(F.coalesce("text", F.lit("")) == "", NO_TEXT)
            .when(~F.col("_replied"), NO_CLIENT)
            .alias("reason"),
            F.when(
                failed,
                F.struct(
                    F.lit(rp.REPLY_ERROR).alias("error_type"),
                    F.col("reply.error").alias("error_message"),
                    F.lit(rp.HINT_REPLY).alias("resolution_hint"),
                ),
            )
            .cast(FALLBACK)
            .alias("fallback_reason"),
            processed_at.alias("ts"),
        ).alias("processing"),
    )
    return joined.select("doc_id", record.alias("record"))


def basic_content(text: Column) -> Column:
    """Content struct of the basic path: ISO dates and dollar amounts only."""
    return F.struct(
        F.coalesce(text, F.lit("")).alias("text"),
        F.array().cast(f"array<{TABLE}>").alias("tables"),
        _no_pairs().alias("key_value_pairs"),
        en.entities(en.basic_dates(text), en.basic_amounts(text)).alias("entities"),
    )


def basic_records(files: DataFrame, processed_at: Column, version: str) -> DataFrame:
    """Records of plain files ``(path, modified_at, checksum, text, error_type,
    error_message)``: the path every cataloged file takes."""
    fallback = F.when(
        F.col("error_type").isNotNull(),
        F.struct(
            F.col("error_type"),
            F.col("error_message"),
            rp.resolution_hint(F.col("error_message")).alias("resolution_hint"),
        ),
    )
    record = F.struct(
        F.struct(
            F.col("checksum"), processed_at.alias("processed_at"), F.lit(version).alias("version")
        ).alias("catalog"),
        F.struct("path", "modified_at").alias("source"),
        F.struct(F.lit(UNKNOWN).alias("type"), F.lit("").alias("purpose")).alias("doc_info"),
        basic_content(F.col("text")).alias("content"),
        F.struct(
            F.lit(TRADITIONAL).alias("method"),
            fallback.cast(FALLBACK).alias("fallback_reason"),
            processed_at.alias("ts"),
        ).alias("processing"),
    )
    return files.select("path", record.alias("record"))


def write_json(records: DataFrame, path: str) -> None:
    """All records as one dataset of JSON lines."""
    records.write.mode("overwrite").json(path)
