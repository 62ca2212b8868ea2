"""The registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each runs one operator over whole tables and returns flat columns.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliomine.functions import entities as en, files as ff, text as tx
from foliomine.operators import (
    categories as kc,
    attributes as at,
    catalog as ca,
    content_index as ci,
    language as la,
    overlap as ov,
    pairs as pa,
    records as re,
    replies as rp,
    scan as sc,
    statements as st,
    tables as tb,
    templates as tp,
)
from foliomine.plans import inputs as src
from foliomine.sources import pages as pg
from foliomine.sources.templates import BUILTIN_TEMPLATES, template_rows

QUERIES = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def _seconds(catalog: DataFrame) -> DataFrame:
    """``created_at`` as whole seconds, the same in every session time zone."""
    return catalog.withColumn("created_s", F.unix_seconds("created_at")).drop("created_at")


def _joined(array: Column | str) -> Column:
    return F.array_join(array, "|", "-")


# --- catalog ---------------------------------------------------------------


@query
def catalog_build(spark: SparkSession, sf: str) -> DataFrame:
    return _seconds(src.current_catalog(spark, sf)).withColumn(
        "extension", ff.extension(F.col("path"))
    )


@query
def catalog_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ca.statistics(src.current_catalog(spark, sf))


@query
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    return _seconds(ca.search(src.current_catalog(spark, sf), "DOC_1"))


@query
def catalog_content_search(spark: SparkSession, sf: str) -> DataFrame:
    found = ca.search_content(src.searchable_files(spark, sf), "license")
    return found.select("path", "name", "rank", "hits")


@query
def catalog_content_top(spark: SparkSession, sf: str) -> DataFrame:
    found = ca.search_content(src.searchable_files(spark, sf), "DER ", limit=25)
    return found.select("path", "rank", "hits")


def _indexed(spark: SparkSession, sf: str, query: str, limit: int | None = None) -> DataFrame:
    files = ci.with_ids(src.searchable_files(spark, sf))
    index = ci.postings(files)
    return ci.search(files, index, ci.gram_counts(index), query, limit)


@query
def catalog_content_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The content search by an index of trigrams."""
    return _indexed(spark, sf, "license").select("path", "name", "rank", "hits")


@query
def catalog_content_indexed_top(spark: SparkSession, sf: str) -> DataFrame:
    return _indexed(spark, sf, "DER ", limit=25).select("path", "rank", "hits")


def _upserted(spark: SparkSession, sf: str) -> DataFrame:
    first = src.as_catalog(src.document_files(spark, sf))
    second = src.as_catalog(src.redelivered_files(spark, sf), src.EPOCH + src.DAY, 1)
    return ca.upsert(first, second)


@query
def catalog_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _seconds(_upserted(spark, sf))


@query
def catalog_latest(spark: SparkSession, sf: str) -> DataFrame:
    return _seconds(ca.latest_by_path(_upserted(spark, sf)))


@query
def catalog_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return ca.public(ca.by_ids(src.current_catalog(spark, sf), src.labelled_ids(spark, sf)))


@query
def catalog_export(spark: SparkSession, sf: str) -> DataFrame:
    found = ca.by_checksums(src.current_catalog(spark, sf), src.requested_checksums(spark, sf))
    return ca.public(found)


@query
def catalog_content_export(spark: SparkSession, sf: str) -> DataFrame:
    files, wanted = src.all_files(spark, sf), src.requested_checksums(spark, sf)
    found = ca.contents(src.current_catalog(spark, sf), wanted, files, content="text")
    return found.select("checksum", "path", F.col("content"))


@query
def catalog_missing(spark: SparkSession, sf: str) -> DataFrame:
    return ca.missing_checksums(src.current_catalog(spark, sf), src.requested_checksums(spark, sf))


@query
def catalog_delete(spark: SparkSession, sf: str) -> DataFrame:
    left = ca.delete(src.current_catalog(spark, sf), src.labelled_ids(spark, sf))
    return left.select("file_id", "checksum", "path")


@query
def catalog_delete_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return ca.unknown_ids(src.current_catalog(spark, sf), src.labelled_ids(spark, sf))


@query
def scan_ignore_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sc.count_scan(src.all_files(spark, sf))


@query
def scan_rules(spark: SparkSession, sf: str) -> DataFrame:
    path, size = F.col("path"), F.octet_length("text")
    return src.all_files(spark, sf).select(
        "path",
        ff.extension(path).alias("extension"),
        sc.indexable(path, size).alias("indexable"),
        sc.ignored(path, mode="glob").alias("ignored_as_glob"),
        sc.type_error(F.col("mime_type")).alias("type_error"),
    )


@query
def mime_sniff(spark: SparkSession, sf: str) -> DataFrame:
    files = src.all_files(spark, sf)
    return files.select("path", ff.mime_type(F.encode("text", "UTF-8")).alias("mime_type"))


# --- pages and entities ----------------------------------------------------


@query
def entities_basic(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return src.notes(spark, sf).select(
        "doc_id",
        _joined(en.basic_dates(text)).alias("dates"),
        _joined(en.basic_amounts(text)).alias("amounts"),
    )


@query
def entities_full(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    found = src.notes(spark, sf).select(
        "doc_id", en.entities(en.dates(text), en.amounts(text)).alias("e")
    )
    return found.select(
        "doc_id",
        _joined("e.dates").alias("dates"),
        _joined("e.amounts").alias("amounts"),
        en.any_entity(F.col("e")).alias("any_found"),
    )


@query
def entities_prose(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return src.prose(spark, sf).select(
        "doc_id",
        _joined(en.dates(text)).alias("dates"),
        _joined(en.amounts(text)).alias("amounts"),
    )


@query
def page_split(spark: SparkSession, sf: str) -> DataFrame:
    return pg.split_pages(src.prose(spark, sf))


@query
def page_join(spark: SparkSession, sf: str) -> DataFrame:
    return pg.join_pages(pg.split_pages(src.prose(spark, sf)))


@query
def page_join_blank_line(spark: SparkSession, sf: str) -> DataFrame:
    return pg.join_pages(pg.split_pages(src.prose(spark, sf)), skip_empty=True)


@query
def kv_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pa.pair_rows(src.rendered(spark, sf), text="text")


@query
def kv_pairs_prose(spark: SparkSession, sf: str) -> DataFrame:
    return pa.pair_rows(src.prose(spark, sf), text="text")


# --- templates -------------------------------------------------------------


@query
def template_scores(spark: SparkSession, sf: str) -> DataFrame:
    return tp.scores(src.with_first_page(src.mixed(spark, sf)))


@query
def classify(spark: SparkSession, sf: str) -> DataFrame:
    return tp.classify(src.with_first_page(src.mixed(spark, sf))).select(
        "doc_id", "doc_type", "score"
    )


def _typed_from_table(spark: SparkSession, sf: str) -> DataFrame:
    page = src.with_first_page(src.fee_statements(spark, sf).unionByName(src.prose(spark, sf)))
    return tp.classify_from(page, src.customer_templates(spark, sf))


@query
def classify_from_table(spark: SparkSession, sf: str) -> DataFrame:
    return _typed_from_table(spark, sf).select("doc_id", "doc_type", "score")


@query
def fields_from_table(spark: SparkSession, sf: str) -> DataFrame:
    found = tp.fields_from(_typed_from_table(spark, sf), src.customer_templates(spark, sf))
    return tp.field_rows(found).select(
        "doc_id",
        "key",
        F.when(F.col("value_num").isNull(), F.col("value")).alias("value"),
        "value_num",
        F.date_format("value_date", "yyyy-MM-dd").alias("value_date"),
    )


def _zoned(spark: SparkSession, sf: str) -> DataFrame:
    return tp.with_zones(tp.classify(src.with_layout(src.rendered(spark, sf))))


@query
def zone_text(spark: SparkSession, sf: str) -> DataFrame:
    return tp.zone_rows(_zoned(spark, sf))


def _page_words(spark: SparkSession, sf: str) -> DataFrame:
    """Page one of each document as rows of words. Pages move by document before they are cut,
    as rows of words take several times the bytes of the text that they are cut from."""
    page = src.with_first_page(src.rendered(spark, sf)).select("doc_id", "page_text")
    laid_out = src.dealt(page, "doc_id").withColumn("words", F.expr(pg.words_from_text("page_text")))
    return tp.rows_of(laid_out, F.inline_outer("words"), "word_no")


def _types(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's type. It passes a generator, as Spark would push a join's filter on it,
    with the whole classification, below the step that deals customers out to tasks."""
    page = src.with_first_page(src.rendered(spark, sf))
    typed = tp.classify(page.select("doc_id", "page_text"))
    return typed.select("doc_id", F.explode_outer(F.array("doc_type")).alias("doc_type"))


@query
def zone_text_from_words(spark: SparkSession, sf: str) -> DataFrame:
    """The same from rows of words, as a layout extractor delivers them."""
    words = _page_words(spark, sf).withColumn("page_no", F.lit(1))
    first = pg.gather_words(words).where("page_no = 1")
    return tp.zone_rows(tp.with_zones(_types(spark, sf).join(first, "doc_id", "left")))


@query
def zone_text_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same from rows of words and a table of zones, joined where they overlap."""
    table = template_rows(spark, BUILTIN_TEMPLATES)
    return ov.zone_texts(_types(spark, sf), _page_words(spark, sf), ov.zone_boxes(table))


@query
def zone_joined_text(spark: SparkSession, sf: str) -> DataFrame:
    return _zoned(spark, sf).select("doc_id", tp.joined_zone_text(F.col("zones")).alias("text"))


@query
def zone_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = tp.match_rows(_zoned(spark, sf))
    return found.select(
        "doc_id", "zone", "pattern_no", "ord", _joined("groups").alias("groups"), "text"
    )


@query
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    value = tp.confidence(F.col("zones"))
    return _zoned(spark, sf).select(
        "doc_id",
        "doc_type",
        F.round(value, 6).alias("confidence"),
        F.round(F.least(value, F.lit(1.0)), 6).alias("confidence_capped"),
    )


@query
def template_fields(spark: SparkSession, sf: str) -> DataFrame:
    typed = tp.classify(src.with_first_page(src.rendered(spark, sf)))
    found = typed.select("doc_id", tp.fields("text").alias("fields"))
    return tp.field_rows(found).select(
        "doc_id",
        "key",
        F.when(F.col("value_num").isNull(), F.col("value")).alias("value"),
        "value_num",
        F.date_format("value_date", "yyyy-MM-dd").alias("value_date"),
    )


# --- statements ------------------------------------------------------------


@query
def transactions(spark: SparkSession, sf: str) -> DataFrame:
    return st.transactions(src.statements(spark, sf)).drop("date_value")


@query
def transactions_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    return st.transactions_of_lines(src.statement_lines(spark, sf)).drop("date_value")


@query
def txn_category(spark: SparkSession, sf: str) -> DataFrame:
    found = st.transactions(src.statements(spark, sf))
    return found.groupBy("category").agg(
        F.count("*").alias("n"), F.sum("amount_cents").alias("total_cents")
    )


@query
def category_from_table(spark: SparkSession, sf: str) -> DataFrame:
    found = kc.categorise(src.document_lines(spark, sf), src.keyword_table(spark, sf))
    return found.select("doc_id", "line_no", "category")


@query
def balances(spark: SparkSession, sf: str) -> DataFrame:
    return src.statements(spark, sf).select(
        "doc_id", st.balances(F.col("text")).alias("b")
    ).select("doc_id", "b.*")


@query
def tables_normalise(spark: SparkSession, sf: str) -> DataFrame:
    rows = tb.table_rows(src.raw_tables(spark, sf))
    return rows.select(
        "doc_id", "page_no", "table_no", "row_no",
        _joined("headers").alias("headers"), _joined("cells").alias("cells"),
    )


@query
def tables_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    tables = tb.of_documents(src.raw_tables(spark, sf))
    rows = F.flatten(F.transform("tables", lambda t: F.transform(t["data"], lambda r: F.array_join(r, "|", "-"))))
    return tables.select(
        "doc_id", F.size("tables").alias("n_tables"), F.array_join(rows, ";").alias("rows")
    )


# --- attributes ------------------------------------------------------------


@query
def attr_list(spark: SparkSession, sf: str) -> DataFrame:
    return at.listing(src.attributes(spark, sf)).select(
        "scope",
        "key",
        F.to_json("value").alias("value"),
        F.to_json("default").alias("default_value"),
        F.schema_of_variant("value").alias("value_type"),
        "description",
    )


@query
def attr_get(spark: SparkSession, sf: str) -> DataFrame:
    requests = src.attribute_changes(spark, sf).select(
        "scope", "key", "seq", F.col("default_value").alias("default")
    )
    found, _ = at.get(src.attributes(spark, sf), requests)
    return found.select("scope", "key", "seq", "raw", F.to_json("value").alias("value"))


@query
def attr_get_rejected(spark: SparkSession, sf: str) -> DataFrame:
    requests = src.attribute_changes(spark, sf).select(
        "scope", "key", F.col("default_value").alias("default")
    )
    return at.get(src.attributes(spark, sf), requests)[1]


@query
def attr_insert(spark: SparkSession, sf: str) -> DataFrame:
    return at.insert(src.attributes(spark, sf), src.attribute_changes(spark, sf))[0]


@query
def attr_insert_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return at.insert(src.attributes(spark, sf), src.attribute_changes(spark, sf))[1]


@query
def attr_update(spark: SparkSession, sf: str) -> DataFrame:
    return at.update(src.attributes(spark, sf), src.attribute_changes(spark, sf))[0]


@query
def attr_update_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return at.update(src.attributes(spark, sf), src.attribute_changes(spark, sf))[1]


@query
def attr_reset(spark: SparkSession, sf: str) -> DataFrame:
    return at.reset(src.attributes(spark, sf), src.attribute_changes(spark, sf))[0]


@query
def attr_reset_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return at.reset(src.attributes(spark, sf), src.attribute_changes(spark, sf))[1]


@query
def attr_seed(spark: SparkSession, sf: str) -> DataFrame:
    return at.seed(src.attributes(spark, sf), src.attribute_defaults(spark, sf))


@query
def attr_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return at.create_or_update(src.attributes(spark, sf), src.attribute_changes(spark, sf))


@query
def attr_commands(spark: SparkSession, sf: str) -> DataFrame:
    return at.apply_commands(src.attributes(spark, sf), src.attribute_commands(spark, sf))[0]


@query
def attr_commands_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return at.apply_commands(src.attributes(spark, sf), src.attribute_commands(spark, sf))[1]


@query
def attr_update_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays as values, stored as JSON."""
    changes = src.attribute_changes(spark, sf).withColumn("value", F.array(F.col("seq") % 100, F.col("seq")))
    return at.update(src.attributes(spark, sf), changes)[0]


def _is_key() -> Column:
    return F.col("key") == "openai.api_key"


@query
def attr_mask(spark: SparkSession, sf: str) -> DataFrame:
    return at.masked(src.secrets(spark, sf), _is_key()).select("scope", "key", "value")


@query
def attr_validate(spark: SparkSession, sf: str) -> DataFrame:
    accepted, rejected = at.validated_keys(src.secrets(spark, sf), _is_key())
    return accepted.select("scope", "key", F.lit("ok").alias("reason")).unionByName(rejected)


# --- AI tables -------------------------------------------------------------


@query
def ai_requests(spark: SparkSession, sf: str) -> DataFrame:
    asked = rp.requests(src.prose(spark, sf))
    return asked.select("doc_id", "chunk_no", "n_chunks", "model", "user_text", "temperature", "response_format")


@query
def ai_reply_normalise(spark: SparkSession, sf: str) -> DataFrame:
    n = rp.normalise(src.turn_replies(spark, sf))
    pair = lambda m, k: F.try_element_at(m, F.lit(k))
    return n.select(
        "doc_id",
        "turn",
        "error",
        "document_type",
        "text",
        pair("metadata", "purpose").alias("purpose"),
        pair("key_value_pairs", "Turn").alias("turn_pair"),
        *[_joined(c).alias(c) for c in ("people", "organizations", "dates", "amounts")],
    )


@query
def ai_chunked_replies(spark: SparkSession, sf: str) -> DataFrame:
    merged = rp.merge(rp.normalise(src.chunk_replies(spark, sf)))
    pairs = F.transform(
        F.array_sort(F.map_entries("key_value_pairs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return merged.select(
        "doc_id",
        "error",
        "document_type",
        F.md5("text").alias("text_md5"),
        F.try_element_at("metadata", F.lit("purpose")).alias("purpose"),
        F.array_join(pairs, ";").alias("pairs"),
        _joined("people").alias("people"),
        _joined("amounts").alias("amounts"),
        "n_parts",
        "n_failed",
    )


@query
def ai_statement_replies(spark: SparkSession, sf: str) -> DataFrame:
    n = rp.normalise_statement(src.statement_replies(spark, sf))
    return n.select(
        "doc_id",
        "error",
        F.col("account_info.holder").alias("holder"),
        F.col("account_info.iban").alias("iban"),
        F.col("statement_details.period").alias("period"),
        F.col("statement_details.opening_balance").alias("opening_balance"),
        F.size("transactions").alias("n_transactions"),
    )


@query
def ai_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return rp.statement_transactions(rp.normalise_statement(src.statement_replies(spark, sf)))


# --- language --------------------------------------------------------------


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "documents").select("lang", "text")


@query
def language_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return la.profiles(_labelled(spark, sf))


@query
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _labelled(spark, sf)
    found = la.detect(src.prose(spark, sf), la.profiles(labelled), la.few_languages(labelled))
    return found.select("*", la.ocr_language(F.col("detected")).alias("ocr_language"))


# --- records ---------------------------------------------------------------


def _archived(documents: DataFrame) -> DataFrame:
    """Texts as documents of one archive."""
    return src.with_first_page(documents).select(
        "*",
        F.concat(F.lit("archive/"), "doc_id").alias("path"),
        ff.checksum(F.col("text")).alias("checksum"),
        F.timestamp_seconds(F.lit(src.EPOCH)).alias("modified_at"),
    )


def records_of(spark: SparkSession, sf: str) -> DataFrame:
    replies = src.document_replies(spark, sf)
    when = F.timestamp_seconds(F.lit(src.EPOCH + src.DAY))
    documents = re.with_replies(src.mixed_by_id(spark, sf), replies)
    extracted = re.extract(_archived(documents), words=pg.words_from_text("page_text"))
    return re.assemble(extracted, when, "0.1.0")


@query
def records(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda name: F.col(f"record.{name}")
    return records_of(spark, sf).select(
        "doc_id",
        r("catalog.checksum").alias("checksum"),
        F.unix_seconds(r("catalog.processed_at")).alias("processed_s"),
        r("source.path").alias("path"),
        r("doc_info.type").alias("type"),
        r("doc_info.purpose").alias("purpose"),
        F.round(r("doc_info.confidence"), 6).alias("confidence"),
        r("doc_info.statement_details.closing_balance").alias("closing_balance"),
        F.md5(r("content.text")).alias("text_md5"),
        F.size(r("content.key_value_pairs")).alias("n_pairs"),
        F.try_element_at(r("content.key_value_pairs"), F.lit("Turn")).alias("last_turn"),
        _joined(r("content.entities.people")).alias("people"),
        _joined(r("content.entities.organizations")).alias("organizations"),
        _joined(r("content.entities.dates")).alias("dates"),
        _joined(r("content.entities.amounts")).alias("amounts"),
        F.size(r("content.transactions")).alias("n_transactions"),
        F.size(r("fields")).alias("n_fields"),
        r("processing.method").alias("method"),
        r("processing.branch").alias("branch"),
        r("processing.reason").alias("reason"),
        r("processing.fallback_reason.error_message").alias("fallback_message"),
    )


@query
def basic_records(spark: SparkSession, sf: str) -> DataFrame:
    files = src.all_files(spark, sf).select(
        "path",
        F.timestamp_seconds(F.lit(src.EPOCH)).alias("modified_at"),
        ff.checksum(F.col("text")).alias("checksum"),
        tx.strip(tx.unify_newlines(F.col("text"))).alias("text"),
        F.lit(None).cast("string").alias("error_type"),
        F.lit(None).cast("string").alias("error_message"),
    )
    made = re.basic_records(files, F.timestamp_seconds(F.lit(src.EPOCH)), "0.1.0")
    r = lambda name: F.col(f"record.{name}")
    return made.select(
        "path",
        r("catalog.checksum").alias("checksum"),
        r("doc_info.type").alias("type"),
        r("processing.method").alias("method"),
        r("content.text").alias("text"),
        _joined(r("content.entities.dates")).alias("dates"),
        _joined(r("content.entities.amounts")).alias("amounts"),
    )


@query
def failed_records(spark: SparkSession, sf: str) -> DataFrame:
    made = re.basic_records(src.failed_files(spark, sf), F.timestamp_seconds(F.lit(src.EPOCH)), "0.1.0")
    fallback = F.col("record.processing.fallback_reason")
    return made.select(
        "path",
        F.col("record.processing.method").alias("method"),
        fallback["error_type"].alias("error_type"),
        fallback["error_message"].alias("error_message"),
        fallback["resolution_hint"].alias("resolution_hint"),
    )
