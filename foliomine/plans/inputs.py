"""Inputs of the registered queries, derived from the supplied tables.

The tables hold prose, orders and events; the operators read files, statements,
notes, layouts, attributes and replies. Each function renders one such input
from whole tables, so it grows with them, and what an extraction must find is
known from the rows it was rendered from.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliomine.functions import files as ff
from foliomine.operators import catalog, replies
from foliomine.operators.attributes import first_per_key
from foliomine.sources import pages
from foliomine.sources.tables import read_table

EPOCH = 1_704_067_200  # 2024-01-01 00:00:00 UTC
DAY = 86_400

# Orders of one customer are split into statements by key range, so that a
# statement has a bounded number of lines whatever the customer's share.
ORDERS_PER_STATEMENT = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows by a hash of ``key``, in as many tasks as a shuffle has. A file of one row group
    is read by one task, and a document costs a thousand times what its row does: the narrow
    rows move before documents are rendered from them, or extracted. The number is given, as
    Spark would join small tasks again by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# --- files -----------------------------------------------------------------


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files, their text still at hand."""
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit("text/plain").alias("mime_type"),
        F.col("doc_id").alias("no"),
        "text",
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as HTML files."""
    return table(spark, sf_dir, "pages").select(
        F.col("url").alias("path"),
        F.lit("text/html").alias("mime_type"),
        F.col("page_id").alias("no"),
        F.col("html").alias("text"),
    )


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).unionByName(page_files(spark, sf_dir))


def as_catalog(files: DataFrame, start: int = EPOCH, batch_no: int = 0) -> DataFrame:
    """Catalog rows of text files; ``created_at`` is a fixed time plus ``no`` seconds."""
    return catalog.catalog_rows(_file_rows(files, start, batch_no))


def _file_rows(files: DataFrame, start: int, batch_no: int) -> DataFrame:
    return files.select(
        ff.checksum(F.col("text")).alias("checksum"),
        ff.base_name(F.col("path")).alias("name"),
        F.octet_length("text").cast("bigint").alias("size"),
        "path",
        "mime_type",
        F.timestamp_seconds(F.lit(start) + F.col("no")).alias("created_at"),
        F.lit(batch_no).cast("bigint").alias("batch_no"),
        "text",
    )


def searchable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with catalog columns and their text, for a search in content."""
    return _file_rows(all_files(spark, sf_dir), EPOCH, 0)


def redelivered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents delivered again with their lines joined: those of one line
    are the same content, the others are new content at the same path."""
    return document_files(spark, sf_dir).withColumn("text", F.translate("text", "\n", " "))


def current_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.distinct_files(as_catalog(all_files(spark, sf_dir)))


def requested_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents asked for: the labelled documents' and the benchmark items'."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    wanted = documents.join(labels, "doc_id", "left_semi").select("text")
    items = table(spark, sf_dir, "benchmark").select("text")
    return wanted.unionByName(items).select(ff.checksum(F.col("text")).alias("checksum"))


def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File ids of the documents labelled toxic, and ids of benchmark items,
    which the catalog does not have."""
    toxic = table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    files = document_files(spark, sf_dir).join(toxic, F.col("no") == F.col("doc_id"), "left_semi")
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"), "text"
    )
    return (
        files.select("path", "text")
        .unionByName(items)
        .select(ff.file_id(ff.checksum(F.col("text")), F.col("path")).alias("file_id"))
    )


# --- rendered documents ----------------------------------------------------


def german(cents: Column) -> Column:
    """Whole cents as ``1.012,34``."""
    euros = F.translate(F.format_number((cents / 100).cast("bigint"), 0), ",", ".")
    return F.concat(euros, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))


def _lines(*parts: Column) -> Column:
    """The parts that are not NULL, one per line."""
    return F.concat_ws("\n", *parts)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _order_entry() -> list[Column]:
    """The lines of an order in a statement; NULL where an order lacks one."""
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    label = F.element_at(
        F.array(*[F.lit(d) for d in ("Miete", "REWE Markt", "Allianz", "Netflix", "Sonstiges")]),
        (key % 5 + 1).cast("int"),
    )
    return [
        _text(F.date_format("o_orderdate", "dd.MM.yyyy"), " ", label, " -", german(cents)),
        F.when(key % 3 == 0, _text("Mandat: M", key)),
        F.when(key % 2 == 0, _text("Referenz: R", key)),
        F.when(key % 7 == 0, _text("Filiale ", key % 7)),
    ]


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, line_no, line)``: the running statement of each customer's account as
    rows, of any length; a line number is the order's key and the place in its entry."""
    entry = F.filter(F.array(*_order_entry()), lambda line: line.isNotNull())
    lines = table(spark, sf_dir, "orders").select(
        _text("acc-", F.col("o_custkey")).alias("doc_id"),
        (F.col("o_orderkey") * 4).alias("first"),
        F.posexplode(entry).alias("i", "line"),
    )
    lines = lines.select("doc_id", (F.col("first") + F.col("i")).alias("line_no"), "line")
    heads = table(spark, sf_dir, "customer").select(
        _text("acc-", F.col("c_custkey")).alias("doc_id"),
        F.lit(-1).cast("bigint").alias("line_no"),
        _text("Girokonto Nummer ", F.col("c_custkey")).alias("line"),
    )
    return heads.unionByName(lines)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: a bank statement per customer and key range."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    entry = _lines(*_order_entry())
    block = F.floor(key / ORDERS_PER_STATEMENT).cast("bigint")
    grouped = (
        table(spark, sf_dir, "orders")
        .select(customer, block.alias("block"), key, cents.alias("cents"), entry.alias("entry"))
        .groupBy("o_custkey", "block")
        .agg(
            F.sort_array(F.collect_list(F.struct("o_orderkey", "entry"))).alias("entries"),
            F.sum("cents").alias("total"),
        )
    )
    head = _lines(
        _text("Girokonto Nummer ", customer),
        F.lit("Kontoauszug Januar 2024"),
        F.lit("IBAN: DE89 3704 0044 0532 0130 00"),
        F.when(customer % 2 == 0, F.lit("BIC: INGDDEFFXXX")),
        _text("Auszugsnummer ", F.col("block") + 1),
        _text("Alter Saldo ", german(customer * 137 + 34), " Euro"),
        _text("Neuer Saldo ", german(F.col("total")), " Euro"),
        F.when(customer % 3 == 0, F.lit("Eingeräumte Kontoüberziehung 2.500,00 Euro")),
    )
    body = F.array_join(F.transform("entries", lambda e: e["entry"]), "\n")
    return grouped.select(
        _text("st-", customer, "-", F.col("block")).alias("doc_id"), _lines(head, body).alias("text")
    )


def fee_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: a fee statement per customer."""
    key = F.col("c_custkey")
    cents = F.round(F.abs("c_acctbal") * 100).cast("bigint")
    day = F.lpad((key % 28 + 1).cast("string"), 2, "0")
    text = _lines(
        F.lit("Entgeltaufstellung"),
        _text("Kontobezeichnung ", F.col("c_mktsegment"), " Konto"),
        F.lit("Kontokennung DE89 3704 0044 0532 0130 00"),
        _text("Zeitraum Von 01.01.2024 bis ", day, ".02.2024"),
        _text("Datum ", day, ".03.2024"),
        F.lit("Anna Muster"),
        F.lit("10115 Berlin"),
        _text("Insgesamt gezahlte Entgelte ", german(cents), " EUR"),
        _text("Insgesamt gezahlte Zinsen -", german(F.floor(cents / 7)), " EUR"),
        F.when(key % 2 == 0, _text("Insgesamt erhaltene Zinsen ", german(key * 10), " EUR")),
        F.lit("Dienst Entgelt"),
        _text("Kontoführung ", german(F.floor(cents / 3)), " EUR"),
        F.lit("Dienstleistungspaket Entgelt 4,90 EUR"),
        _text("Karte: ", F.col("c_name")),
        F.lit("Ende der Aufstellung"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_name")
    return dealt(customers, "c_custkey").select(_text("fee-", key).alias("doc_id"), text.alias("text"))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return documents.select(_text("doc-", F.col("doc_id")).alias("doc_id"), "text")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).unionByName(fee_statements(spark, sf_dir))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir).unionByName(prose(spark, sf_dir))


def mixed_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, dealt out by their ids as a join by them needs it: prose moves once, and what
    is made of a text doesn't move with it."""
    documents = table(spark, sf_dir, "documents").select(_text("doc-", F.col("doc_id")).alias("doc_id"), "text")
    return dealt(rendered(spark, sf_dir).unionByName(documents), "doc_id")


def with_first_page(documents: DataFrame) -> DataFrame:
    return documents.select("*", pages.first_page(F.col("text")).alias("page_text"))


def with_layout(documents: DataFrame) -> DataFrame:
    """Page one as text and as words with boxes."""
    return with_first_page(documents).select(
        "*", F.expr(pages.words_from_text("page_text")).alias("words")
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: a payment note per event, in three formats."""
    value = F.format_string("%.2f", F.abs("value"))
    day = lambda fmt: F.date_format("ts", fmt)
    text = (
        F.when(F.col("event_id") % 3 == 0, _text("Paid $", value, " on ", day("yyyy-MM-dd")))
        .when(F.col("event_id") % 3 == 1, _text("Paid €", value, " on ", day("dd.MM.yyyy")))
        .otherwise(_text("Paid ", value, " EUR on ", day("dd/MM/yyyy")))
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), text.alias("text"))


_TABLES = "array<array<array<string>>>"


def raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, page_no, tables)``: every line item as a page with a table of two data
    rows, a table of headers alone on first pages, and a table of empty cells on the
    pages of every fifth order."""
    head = F.array(F.lit("part"), F.lit("qty"), F.lit("flag"))
    row = F.array(
        F.col("l_partkey").cast("string"),
        F.col("l_quantity").cast("bigint").cast("string"),
        F.col("l_returnflag"),
    )
    empty = F.array(F.array(F.lit(""), F.lit(None).cast("string")), F.array(F.lit("")))
    second = F.array(F.col("l_suppkey").cast("string"), F.lit(None).cast("string"), F.col("l_linestatus"))
    tables = F.concat(
        F.when(F.col("l_orderkey") % 5 == 0, F.array(empty)).otherwise(F.array().cast(_TABLES)),
        F.array(F.array(head, row, second)),
        F.when(F.col("l_linenumber") == 1, F.array(F.array(head))).otherwise(F.array().cast(_TABLES)),
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("page_no"),
        tables.alias("tables"),
    )


def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(category, priority, keyword)``: the words of each benchmark item as the keywords
    of a category of its own, longer words first."""
    words = table(spark, sf_dir, "benchmark").select(
        _text("item-", F.col("item_id")).alias("category"),
        F.explode(F.array_distinct(F.split("text", r"[^\p{L}]+"))).alias("keyword"),
    )
    return words.select("category", (100 - F.length("keyword")).alias("priority"), "keyword")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, line_no, description)``: the lines of the documents."""
    documents = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    lines = documents.select(
        "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "description")
    )
    return lines.where(F.col("line_no").isNotNull())


def customer_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template per customer: a fee statement is of its customer's card. The patterns of
    a segment's customers differ in their ends alone."""
    key = F.col("c_custkey")
    template = F.col("c_custkey").cast("int")
    name = F.col("c_name")
    zones = "array<struct<name:string,bounds:array<double>,content_type:string,patterns:array<string>,required:boolean>>"

    def field(key: str, regex: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), regex.alias("pattern"))

    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return dealt(customers, "c_custkey").select(
        template.alias("template_no"),
        _text("card of ", name).alias("name"),
        F.array(
            F.concat(F.lit(r"KARTE:\s+"), name, F.lit(r"\b")),
            F.concat(F.lit(r"Bezeichnung\s+"), F.col("c_mktsegment"), F.lit(r" Konto[\s\S]*#0*"), key.cast("string"), F.lit(r"\s")),
        ).alias("identifiers"),
        F.array().cast(zones).alias("zones"),
        F.array(
            field("total_fees", F.lit(r"Insgesamt\s+gezahlte\s+Entgelte\s*(-?[\d.,]+)\s*EUR")),
            field("statement_date", F.lit(r"Datum\s+(\d{2}\.\d{2}\.\d{4})")),
            field("card", F.concat(F.lit("("), name, F.lit(")"))),
        ).alias("fields"),
    )


# --- attributes ------------------------------------------------------------


def _as_attributes(rows: DataFrame, scope: Column, user: Column, k: Column, no: Column) -> DataFrame:
    """Rows as attributes: the key names user and property. Values are numbers,
    arrays and bare words; half have a default."""
    value = (
        F.when(no % 3 == 0, k)
        .when(no % 3 == 1, F.concat(F.lit("["), k, F.lit(",1]")))
        .otherwise(F.concat(F.lit("v"), k))
    )
    return rows.select(
        scope.alias("scope"),
        _text("user", user, ".k", k).alias("key"),
        no.alias("seq"),
        value.alias("value"),
        F.when(no % 2 == 0, F.lit("0")).alias("default_value"),
        _text("from row ", no).alias("description"),
    )


# Scopes of the attributes: the types of events.
SCOPES = ["view", "signup", "click", "error", "purchase"]


def attribute_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change per order, ordered by ``seq``. Keys repeat; some are keys of the current
    table, most are new, and most current keys are left alone."""
    orders, key, customer = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    scope = F.element_at(F.array(*map(F.lit, SCOPES)), (customer % 5 + 1).cast("int"))
    return _as_attributes(orders, scope, customer, (key % 100).cast("string"), key)


def attribute_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command per order: the changes as a log of all four kinds."""
    command = F.element_at(
        F.array(*map(F.lit, ("insert", "update", "reset", "upsert"))), (F.col("seq") % 7 % 4 + 1).cast("int")
    )
    return attribute_changes(spark, sf_dir).withColumn("command", command)


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current table: what the first event set per key."""
    events = table(spark, sf_dir, "events")
    rows = _as_attributes(
        events, F.col("event_type"), F.col("user_id"), F.get_json_object("props", "$.k"), F.col("event_id")
    )
    return first_per_key(rows).drop("seq")


def attribute_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default for every key that any change names."""
    keys = attribute_changes(spark, sf_dir).select("scope", "key").distinct()
    return keys.select("*", F.lit("0").alias("value"), F.lit("seeded").alias("description"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An API key per customer, some of a wrong form."""
    key = F.col("c_custkey")
    value = _text(
        F.when(key % 3 == 0, "sk-").when(key % 3 == 1, "org-").otherwise("key-"),
        F.md5(key.cast("string")),
    )
    return table(spark, sf_dir, "customer").select(
        _text("customer", key).alias("scope"),
        F.lit("openai.api_key").alias("key"),
        value.alias("value"),
        F.lit(None).cast("string").alias("default_value"),
        F.lit("service key").alias("description"),
    )


# --- AI replies ------------------------------------------------------------


def turn_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, turn, reply)``: a JSON reply per turn of a conversation. By
    conversation some fields are left out and some replies are no JSON."""
    conv = F.col("conv_id")
    skip = conv % 4
    reply = F.to_json(
        F.struct(
            F.when(skip != 0, F.col("role")).alias("document_type"),
            F.when(skip != 1, F.create_map(F.lit("purpose"), F.lit("chat"))).alias("metadata"),
            F.when(skip != 2, F.col("text")).alias("text"),
            F.when(skip != 3, F.create_map(F.lit("Turn"), F.col("turn").cast("string"))).alias(
                "key_value_pairs"
            ),
            F.when(skip == 0, F.array(F.concat(F.lit("Person "), conv.cast("string")))).alias("people"),
            F.when(skip == 1, F.array(F.lit("Bank AG"), F.col("role"))).alias("organizations"),
            F.when(skip == 2, F.array(F.lit("2024-01-31"))).alias("dates"),
            F.when(skip == 3, F.array(F.lit("12.50"), F.col("turn").cast("string"))).alias("amounts"),
        )
    )
    broken = F.when(conv % 20 == 0, F.lit("[1, 2]")).otherwise(F.concat(F.lit("Sorry: "), "text"))
    return table(spark, sf_dir, "conversations").select(
        conv.alias("doc_id"), "turn", F.when(conv % 10 == 0, broken).otherwise(reply).alias("reply")
    )


def document_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies to all turns of each conversation, merged in their order, as the reply to
    the document of its number."""
    turns = replies.normalise(turn_replies(spark, sf_dir))
    merged = replies.merge(turns, part="turn", separator="\n")
    return merged.withColumn("doc_id", _text("doc-", F.col("doc_id")))


def chunk_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, chunk_no, reply)``: a JSON reply to each chunk of each document's text.
    Keys and names come back in several chunks, some replies are no JSON."""
    no = F.col("chunk_no")
    number = no.cast("string")
    reply = F.to_json(
        F.struct(
            F.when(no % 2 == 0, _text("type", no)).alias("document_type"),
            F.create_map(F.lit("purpose"), _text("part ", no)).alias("metadata"),
            F.col("user_text").alias("text"),
            F.create_map(_text("k", no % 4), number).alias("key_value_pairs"),
            F.array(_text("P", no % 3), F.lit("Ann")).alias("people"),
            F.when(no % 2 == 1, F.array(number)).alias("amounts"),
        )
    )
    broken = F.length("user_text") % 10 == 3
    return replies.requests(prose(spark, sf_dir)).select(
        "doc_id", "chunk_no", F.when(broken, F.lit("Sorry")).otherwise(reply).alias("reply")
    )


def failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain files, one per event, whose AI step failed with a message of its type."""
    quota = F.col("event_type").isin("error", "click")
    return table(spark, sf_dir, "events").select(
        _text("event/", F.col("event_id")).alias("path"),
        F.timestamp_seconds(F.lit(EPOCH)).alias("modified_at"),
        ff.checksum(F.col("props")).alias("checksum"),
        F.col("props").alias("text"),
        F.when(quota, "RateLimitError").otherwise("TimeoutError").alias("error_type"),
        F.when(quota, _text("Quota exceeded on ", F.col("event_type")))
        .otherwise(_text("no answer to ", F.col("event_type")))
        .alias("error_message"),
    )


def statement_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, reply)``: a statement reply per order, some without details."""
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    none = F.lit(None).cast("string")

    def entry(description: Column, amount: Column, category: Column, reference: Column) -> Column:
        return F.struct(
            day.alias("date"),
            description.alias("description"),
            amount.alias("amount"),
            category.alias("category"),
            reference.alias("reference"),
        )

    entries = F.array(
        entry(F.col("o_orderpriority"), -cents / 100, F.lit("other"), none),
        entry(F.lit("Gebühr"), F.lit(-1.5), none, _text("R", key)),
    )
    account = F.struct(
        _text("Customer ", F.col("o_custkey")).alias("holder"),
        F.lit("DE89370400440532013000").alias("iban"),
    )
    details = F.struct(
        F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        (cents / 100).alias("opening_balance"),
    )
    reply = F.to_json(
        F.struct(
            account.alias("account_info"),
            F.when(key % 3 != 0, details).alias("statement_details"),
            F.when(key % 4 != 0, entries).alias("transactions"),
        )
    )
    broken = F.lit("no statement")
    return table(spark, sf_dir, "orders").select(
        key.alias("doc_id"), F.when(key % 10 == 0, broken).otherwise(reply).alias("reply")
    )
