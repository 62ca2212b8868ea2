"""SQL twins of the registered queries, for DuckDB over the supplied tables.

Where a query extracts what was rendered from table rows, the twin states the
expected result from those rows where that can be said in SQL, and otherwise
renders the same text and matches it with SQL's own functions.
"""

import re

from foliomine.functions import entities as en
from foliomine.functions.categories import CATEGORY_KEYWORDS
from foliomine.functions.text import WHITESPACE
from foliomine.operators import language, replies, scan
from foliomine.plans.inputs import DAY, EPOCH, ORDERS_PER_STATEMENT, SCOPES
from foliomine.sources.pages import LINES_PER_PAGE
from foliomine.sources.templates import BUILTIN_TEMPLATES

ORACLES: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NL = "chr(10)"
SPACE = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def _strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def _bag(text: str, patterns: list[str]) -> str:
    found = ", ".join(f"regexp_extract_all({text}, {_q(p)})" for p in patterns)
    return f"array_to_string(flatten([{found}]), '|')"


# --- catalog ---------------------------------------------------------------

DOCUMENT_FILES = """
    SELECT source || '/doc_' || doc_id || '.txt' AS path, 'text/plain' AS mime_type,
           doc_id AS no, text FROM documents"""
FILES = f"""{DOCUMENT_FILES}
    UNION ALL SELECT url, 'text/html', page_id, html FROM pages"""


def _catalog(files: str, start: int = EPOCH, batch_no: int = 0) -> str:
    return f"""
    SELECT md5(sha256(text) || '|' || path) AS file_id, sha256(text) AS checksum,
           regexp_extract(path, '[^/]*$') AS name, CAST(strlen(text) AS BIGINT) AS size, path,
           mime_type, CAST({batch_no} AS BIGINT) AS batch_no,
           CAST({start} + no AS BIGINT) AS created_s
    FROM ({files})"""


CATALOG = f"""
    SELECT DISTINCT ON (checksum, path) * FROM ({_catalog(FILES)}) ORDER BY checksum, path, created_s DESC"""
UPSERTED = f"""
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY checksum, path
                                   ORDER BY created_s DESC, batch_no DESC) AS rn
      FROM ({_catalog(DOCUMENT_FILES)} UNION ALL
            {_catalog("SELECT path, mime_type, no, replace(text, chr(10), ' ') AS text FROM (" + DOCUMENT_FILES + ")", EPOCH + DAY, 1)})
    ) WHERE rn = 1"""
REQUESTS = """
    SELECT sha256(text) AS checksum FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
    UNION ALL SELECT sha256(text) FROM benchmark"""
IDS = f"""
    SELECT md5(sha256(text) || '|' || path) AS file_id FROM ({DOCUMENT_FILES})
    WHERE no IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT md5(sha256(text) || '|benchmark/' || item_id) FROM benchmark"""


def _extension(path: str) -> str:
    name = f"regexp_extract({path}, '[^/]*$')"
    return f"lower(regexp_extract({name}, '(?s)^\\.*[^.].*(\\.[^.]*)$', 1))"


ORACLES["catalog_build"] = f"SELECT *, {_extension('path')} AS extension FROM ({CATALOG})"
ORACLES["catalog_stats"] = (
    f"SELECT count(*) AS total_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM ({CATALOG})"
)
ORACLES["catalog_search"] = (
    f"SELECT * FROM ({CATALOG}) WHERE name ILIKE '%DOC_1%' OR path ILIKE '%DOC_1%' ORDER BY created_s DESC"
)


def _content_search(needle: str) -> str:
    like = _q(f"%{needle}%")
    hits = f"(length(lower(text)) - length(replace(lower(text), lower({_q(needle)}), ''))) // {len(needle)}"
    return f"""
    SELECT path, regexp_extract(path, '[^/]*$') AS name, sha256(text) AS checksum, {EPOCH} + no AS created_s,
           CAST(CASE WHEN regexp_extract(path, '[^/]*$') ILIKE {like} THEN 3 WHEN path ILIKE {like} THEN 2
                ELSE 1 END AS INTEGER) AS rank, CAST({hits} AS BIGINT) AS hits
    FROM ({FILES}) WHERE path ILIKE {like} OR text ILIKE {like}"""


ORACLES["catalog_content_search"] = (
    f"SELECT path, name, rank, hits FROM ({_content_search('license')})"
)
ORACLES["catalog_content_top"] = (
    f"SELECT path, rank, hits FROM ({_content_search('DER ')})"
    " ORDER BY rank DESC, hits DESC, created_s DESC, path, checksum LIMIT 25"
)
ORACLES["catalog_content_indexed"] = ORACLES["catalog_content_search"]
ORACLES["catalog_content_indexed_top"] = ORACLES["catalog_content_top"]
ORACLES["catalog_upsert"] = f"SELECT * FROM ({UPSERTED})"
ORACLES["catalog_latest"] = f"""
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY path ORDER BY created_s DESC, batch_no DESC) AS rn
      FROM ({UPSERTED})) WHERE rn = 1"""
_PUBLIC = "path, name, size, checksum, mime_type"
ORACLES["catalog_lookup"] = (
    f"SELECT {_PUBLIC} FROM ({CATALOG}) WHERE file_id IN (SELECT file_id FROM ({IDS}))"
)
ORACLES["catalog_export"] = f"""
    SELECT {_PUBLIC} FROM (
      SELECT *, row_number() OVER (PARTITION BY checksum ORDER BY created_s, path) AS rn
      FROM ({CATALOG})) WHERE rn = 1 AND checksum IN (SELECT checksum FROM ({REQUESTS}))"""
ORACLES["catalog_content_export"] = f"""
    SELECT checksum, f.path, any_value(text) AS content
    FROM ({ORACLES["catalog_export"]}) e JOIN ({FILES}) f
      ON f.path = e.path AND sha256(f.text) = e.checksum GROUP BY checksum, f.path"""
ORACLES["catalog_missing"] = f"""
    SELECT DISTINCT checksum FROM ({REQUESTS})
    WHERE checksum NOT IN (SELECT checksum FROM ({CATALOG}))"""
ORACLES["catalog_delete"] = f"""
    SELECT file_id, checksum, path FROM ({CATALOG})
    WHERE file_id NOT IN (SELECT file_id FROM ({IDS}))"""
ORACLES["catalog_delete_unknown"] = f"""
    SELECT DISTINCT file_id FROM ({IDS})
    WHERE file_id NOT IN (SELECT file_id FROM ({CATALOG}))"""

_IGNORED = " OR ".join(f"contains(path, {_q(p)})" for p in scan.IGNORE_PATTERNS)


def _glob(patterns: list[str]) -> str:
    """A glob over whole path parts: at the start or after a slash, up to a slash or the end."""
    tests = []
    for p in patterns:
        like = p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        like = like.replace("*", "%").replace("?", "_")
        tests.append(f"'/' || path || '/' LIKE {_q('%/' + like + '/%')} ESCAPE '\\'")
    return " OR ".join(tests)


ORACLES["scan_ignore_counts"] = (
    f"SELECT count(*) FILTER (NOT ({_IGNORED})) AS processed, count(*) FILTER ({_IGNORED}) AS skipped FROM ({FILES})"
)
ORACLES["scan_rules"] = f"""
    SELECT path, {_extension('path')} AS extension,
           {_extension('path')} IN ({', '.join(map(_q, scan.INDEX_EXTENSIONS))})
             AND strlen(text) <= {scan.MAX_FILE_SIZE} AND NOT ({_glob(scan.INDEX_IGNORE_GLOBS)}) AS indexable,
           ({_glob(scan.IGNORE_PATTERNS)}) AS ignored_as_glob,
           CASE WHEN mime_type NOT IN ({', '.join(map(_q, scan.SUPPORTED_TYPES))})
                THEN 'UNSUPPORTED_FILE_TYPE' END AS type_error
    FROM ({FILES})"""
ORACLES["mime_sniff"] = f"""
    SELECT path, CASE WHEN strlen(text) = 0 THEN 'inode/x-empty'
        WHEN starts_with(text, '%PDF') THEN 'application/pdf'
        WHEN regexp_matches(text, '(?i)\\A\\s*<(?:!doctype html|html)') THEN 'text/html'
        ELSE 'text/plain' END AS mime_type FROM ({FILES})"""

# --- notes and pages -------------------------------------------------------

_VALUE = "format('{:.2f}', abs(value))"
ORACLES["entities_full"] = f"""
    SELECT event_id AS doc_id,
      CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%d.%m.%Y')
           ELSE strftime(ts, '%d/%m/%Y') END AS dates,
      CASE event_id % 3 WHEN 0 THEN '$' || {_VALUE} WHEN 1 THEN '€' || {_VALUE}
           ELSE {_VALUE} || ' EUR' END AS amounts,
      true AS any_found
    FROM events"""
ORACLES["entities_basic"] = f"""
    SELECT event_id AS doc_id,
      CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS dates,
      CASE WHEN event_id % 3 = 0 THEN '$' || {_VALUE} ELSE '' END AS amounts
    FROM events"""
PROSE = "SELECT 'doc-' || doc_id AS doc_id, text FROM documents"
ORACLES["entities_prose"] = f"""
    SELECT doc_id, {_bag('text', en.DATE_PATTERNS)} AS dates, {_bag('text', en.AMOUNT_PATTERNS)} AS amounts
    FROM ({PROSE})"""
PAGES = f"""
    SELECT doc_id, CAST((line_no - 1) // {LINES_PER_PAGE} + 1 AS INTEGER) AS page_no,
           string_agg(line, {NL} ORDER BY line_no) AS text
    FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS line,
                 generate_subscripts(string_split(text, {NL}), 1) AS line_no FROM ({PROSE}))
    GROUP BY ALL"""
ORACLES["page_split"] = PAGES
ORACLES["page_join"] = f"SELECT doc_id, {_strip('text')} AS text FROM ({PROSE})"
ORACLES["page_join_blank_line"] = f"""
    SELECT doc_id, coalesce(string_agg(text, {NL} || {NL} ORDER BY page_no) FILTER (text <> ''), '') AS text
    FROM ({PAGES}) GROUP BY doc_id"""

# --- rendered statements ---------------------------------------------------


def _german(cents: str) -> str:
    return (
        f"(replace(format('{{:,}}', CAST(({cents}) // 100 AS BIGINT)), ',', '.') || ',' ||"
        f" lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0'))"
    )


ORDERS = f"""
    SELECT o_custkey AS c, o_orderkey // {ORDERS_PER_STATEMENT} AS b, o_orderkey AS k, o_orderdate AS d,
           CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
           ['Miete', 'REWE Markt', 'Allianz', 'Netflix', 'Sonstiges'][o_orderkey % 5 + 1] AS label
    FROM orders"""
STATEMENTS = f"""
    SELECT 'st-' || c || '-' || b AS doc_id, concat_ws({NL},
      'Girokonto Nummer ' || c, 'Kontoauszug Januar 2024', 'IBAN: DE89 3704 0044 0532 0130 00',
      CASE WHEN c % 2 = 0 THEN 'BIC: INGDDEFFXXX' END, 'Auszugsnummer ' || (b + 1),
      'Alter Saldo ' || {_german('c * 137 + 34')} || ' Euro', 'Neuer Saldo ' || {_german('total')} || ' Euro',
      CASE WHEN c % 3 = 0 THEN 'Eingeräumte Kontoüberziehung 2.500,00 Euro' END, body) AS text
    FROM (SELECT c, b, CAST(sum(cents) AS BIGINT) AS total, string_agg(concat_ws({NL},
            strftime(d, '%d.%m.%Y') || ' ' || label || ' -' || {_german('cents')},
            CASE WHEN k % 3 = 0 THEN 'Mandat: M' || k END, CASE WHEN k % 2 = 0 THEN 'Referenz: R' || k END,
            CASE WHEN k % 7 = 0 THEN 'Filiale ' || k % 7 END), {NL} ORDER BY k) AS body
          FROM ({ORDERS}) GROUP BY c, b)"""
_DAY = "lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0')"
FEES = f"""
    SELECT 'fee-' || c_custkey AS doc_id, concat_ws({NL}, 'Entgeltaufstellung',
      'Kontobezeichnung ' || c_mktsegment || ' Konto', 'Kontokennung DE89 3704 0044 0532 0130 00',
      'Zeitraum Von 01.01.2024 bis ' || {_DAY} || '.02.2024', 'Datum ' || {_DAY} || '.03.2024',
      'Anna Muster', '10115 Berlin', 'Insgesamt gezahlte Entgelte ' || {_german('cents')} || ' EUR',
      'Insgesamt gezahlte Zinsen -' || {_german('cents // 7')} || ' EUR',
      CASE WHEN c_custkey % 2 = 0 THEN 'Insgesamt erhaltene Zinsen ' || {_german('c_custkey * 10')} || ' EUR' END,
      'Dienst Entgelt', 'Kontoführung ' || {_german('cents // 3')} || ' EUR',
      'Dienstleistungspaket Entgelt 4,90 EUR', 'Karte: ' || c_name, 'Ende der Aufstellung') AS text
    FROM (SELECT *, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS cents FROM customer)"""
RENDERED = f"{STATEMENTS} UNION ALL {FEES}"


def _first_page(documents: str) -> str:
    page = f"array_to_string(list_slice(string_split(text, {NL}), 1, {LINES_PER_PAGE}), {NL})"
    return f"SELECT doc_id, text, {page} AS page_text FROM ({documents})"


_KEY = r"[A-Za-zäöüÄÖÜß\s]+"
_PAIR_RULES = [
    rf"({_KEY}):\s*([^\n]+)",
    rf"({_KEY})\s+(\d[\d\s.,]+(?:EUR|€)?(?:\s*p\.a\.)?)",
]


def _pairs(documents: str, text: str) -> str:
    rules = " UNION ALL ".join(
        f"""SELECT doc_id, {no} AS rule, generate_subscripts(regexp_extract_all({text}, {_q(p)}, 1), 1) AS n,
            unnest(regexp_extract_all({text}, {_q(p)}, 1)) AS k, unnest(regexp_extract_all({text}, {_q(p)}, 2)) AS v
            FROM d"""
        for no, p in enumerate(_PAIR_RULES)
    )
    return f"""
    WITH d AS MATERIALIZED ({documents}),
    p AS (SELECT doc_id, rule, n, {_strip('k')} AS key, {_strip('v')} AS value FROM ({rules}))
    SELECT doc_id, key, value FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY rule DESC, n DESC) AS rn
      FROM p WHERE length(key) > 2 AND value <> '') WHERE rn = 1"""


ORACLES["kv_pairs"] = _pairs(RENDERED, "text")
ORACLES["kv_pairs_prose"] = _pairs(PROSE, "text")

# --- templates -------------------------------------------------------------


def _re2(p: str) -> str:
    """A pattern without the possessive form, which RE2 neither has nor needs."""
    return p.replace(r"][^\n]++)", r"]+[^\n]+)")


def _score(template) -> str:
    return " + ".join(
        f"len(regexp_extract_all(page_text, {_q(p)}, 0, 'i'))" for p in template.identifiers
    )


MIXED = f"{RENDERED} UNION ALL {PROSE}"
ORACLES["template_scores"] = f"WITH d AS MATERIALIZED ({_first_page(MIXED)}) " + " UNION ALL ".join(
    f"SELECT doc_id, {_q(t.name)} AS template, CAST({_score(t)} AS INTEGER) AS score FROM d"
    for t in BUILTIN_TEMPLATES
)


def _typed(documents: str) -> str:
    bank, fee = (f"({_score(t)})" for t in BUILTIN_TEMPLATES)
    return f"""
    SELECT doc_id, text, page_text, CASE WHEN bank = 0 AND fee = 0 THEN NULL WHEN bank >= fee
           THEN 'bank_statement' ELSE 'fee_statement' END AS doc_type,
           CAST(greatest(bank, fee) AS INTEGER) AS score
    FROM (SELECT *, {bank} AS bank, {fee} AS fee FROM ({_first_page(documents)}))"""


ORACLES["classify"] = f"SELECT doc_id, doc_type, score FROM ({_typed(MIXED)})"

_ZONES = ", ".join(
    f"({_q(t.name)}, {_q(z.name)}, {no}, {z.bounds[0]}, {z.bounds[1]}, {z.bounds[2]}, {z.bounds[3]}, {len(z.patterns)})"
    for t in BUILTIN_TEMPLATES
    for no, z in enumerate(t.zones)
)


def _zone_ctes(documents: str) -> str:
    """``docs``, ``zones`` and ``zt``: the text of every zone, empty ones included."""
    return f"""
    docs AS MATERIALIZED ({_typed(documents)}),
    zones(doc_type, zone, zone_no, x1, y1, x2, y2, n_patterns) AS (VALUES {_ZONES}),
    lines AS (SELECT doc_id, doc_type, len(string_split(page_text, {NL})) AS n,
                unnest(string_split(page_text, {NL})) AS line,
                generate_subscripts(string_split(page_text, {NL}), 1) - 1 AS i
              FROM docs WHERE doc_type IS NOT NULL),
    words AS (SELECT doc_id, doc_type, i, n, len(ws) AS m, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS j
              FROM (SELECT *, list_filter(string_split(line, ' '), lambda w: w <> '') AS ws FROM lines)),
    zl AS (SELECT doc_id, zone, i, string_agg(word, ' ' ORDER BY j) AS line
           FROM words JOIN zones USING (doc_type)
           WHERE j / m < x2 AND (j + 1) / m > x1 AND i / n < y2 AND (i + 1) / n > y1
           GROUP BY doc_id, zone, i),
    zg AS (SELECT doc_id, zone, string_agg(line, {NL} ORDER BY i) AS text FROM zl GROUP BY doc_id, zone),
    zt AS MATERIALIZED (SELECT doc_id, doc_type, zone, CAST(zone_no AS INTEGER) AS zone_no, n_patterns,
                   coalesce(zg.text, '') AS text
           FROM docs JOIN zones USING (doc_type) LEFT JOIN zg USING (doc_id, zone))"""


ORACLES["zone_text"] = (
    f"WITH {_zone_ctes(RENDERED)} SELECT doc_id, doc_type, zone, zone_no, text FROM zt"
)
ORACLES["zone_text_from_words"] = ORACLES["zone_text"]
ORACLES["zone_text_joined"] = ORACLES["zone_text"]
_JOINED_ZONES = f"""coalesce(string_agg('[' || zone || ']' || {NL} || text, {NL} || {NL} ORDER BY zone_no)
                   FILTER (text <> ''), '')"""
ORACLES["zone_joined_text"] = (
    f"WITH {_zone_ctes(RENDERED)} SELECT doc_id, {_JOINED_ZONES} AS text FROM zt GROUP BY doc_id"
)


def _zone_matches() -> str:
    parts = []
    for t in BUILTIN_TEMPLATES:
        for z in t.zones:
            for no, p in enumerate(z.patterns):
                find = lambda g: f"regexp_extract_all(text, {_q('(?im)' + _re2(p))}, {g})"
                groups = " || '|' || ".join(
                    f"coalesce(nullif({find(g)}[i + 1], ''), '-')" for g in range(1, re.compile(p).groups + 1)
                )
                parts.append(
                    f"""SELECT doc_id, zone, {no} AS pattern_no, CAST(i AS INTEGER) AS ord,
                        {groups or "''"} AS groups, {find(0)}[i + 1] AS text
                        FROM (SELECT *, unnest(range(len({find(0)}))) AS i FROM zt
                              WHERE doc_type = {_q(t.name)} AND zone = {_q(z.name)})"""
                )
    return " UNION ALL ".join(parts)


ORACLES["zone_matches"] = f"WITH {_zone_ctes(RENDERED)} {_zone_matches()}"


def _confidence_ctes(documents: str) -> str:
    return f"""{_zone_ctes(documents)},
    found AS ({_zone_matches()}),
    counted AS (SELECT doc_id, zone, count(*) AS n FROM found GROUP BY ALL),
    conf AS (SELECT doc_id, doc_type, sum(coalesce(n, 0) / n_patterns) / count(*) AS c
             FROM zt LEFT JOIN counted USING (doc_id, zone) GROUP BY ALL)"""


ORACLES["confidence"] = f"""
    WITH {_confidence_ctes(RENDERED)}
    SELECT doc_id, doc_type, round(c, 6) AS confidence, round(least(c, 1.0), 6) AS confidence_capped FROM conf"""


def _amount(x: str) -> str:
    bare = _strip(f"replace(replace({x}, 'EUR', ''), '€', '')")
    return f"coalesce(TRY_CAST(replace(replace({bare}, '.', ''), ',', '.') AS DOUBLE), 0.0)"


def _iso(x: str) -> str:
    part = lambda i: _strip(f"string_split({x}, '.')[{i}]")
    return (
        f"CASE WHEN len(string_split({x}, '.')) = 3 THEN {part(3)} || '-' || {part(2)} || '-' || {part(1)}"
        f" ELSE {x} END"
    )


def _fields(source: str) -> str:
    parts = []
    for t in BUILTIN_TEMPLATES:
        for key, p in t.fields.items():
            raw = f"regexp_extract_all(text, {_q('(?im)' + _re2(p))}, 1)[-1]"
            amount = any(w in key for w in ("amount", "balance", "total"))
            date = not amount and any(w in key for w in ("date", "period"))
            value = "NULL" if amount else _iso("raw") if date else "raw"
            parts.append(
                f"""SELECT doc_id, {_q(key)} AS key, CAST({value} AS VARCHAR) AS value,
                    CAST({_amount('raw') if amount else 'NULL'} AS DOUBLE) AS value_num,
                    CAST({f"CASE WHEN TRY_CAST({value} AS DATE) IS NOT NULL THEN {value} END" if date else 'NULL'}
                         AS VARCHAR) AS value_date
                    FROM (SELECT doc_id, {raw} AS raw FROM {source} WHERE doc_type = {_q(t.name)})
                    WHERE raw IS NOT NULL"""
            )
    return " UNION ALL ".join(parts)


ORACLES["classify_from_table"] = """
    SELECT 'fee-' || c_custkey AS doc_id, 'card of ' || c_name AS doc_type, CAST(2 AS INTEGER) AS score FROM customer
    UNION ALL SELECT 'doc-' || doc_id, NULL, 0 FROM documents"""
ORACLES["fields_from_table"] = f"""
    WITH f AS (SELECT 'fee-' || c_custkey AS doc_id, c_name, CAST(round(abs(c_acctbal) * 100) AS BIGINT) / 100 AS fees,
                      '2024-03-' || {_DAY} AS day FROM customer)
    SELECT doc_id, 'card' AS key, c_name AS value, CAST(NULL AS DOUBLE) AS value_num, NULL AS value_date FROM f
    UNION ALL SELECT doc_id, 'total_fees', NULL, fees, NULL FROM f
    UNION ALL SELECT doc_id, 'statement_date', day, NULL, day FROM f"""
ORACLES["template_fields"] = f"WITH docs AS MATERIALIZED ({_typed(RENDERED)}) {_fields('docs')}"

# --- statements ------------------------------------------------------------

TRANSACTIONS = f"""
    SELECT 'st-' || c || '-' || b AS doc_id,
      CAST(row_number() OVER (PARTITION BY c, b ORDER BY k) AS INTEGER) AS txn_no,
      strftime(d, '%Y-%m-%d') AS date, -cents / 100 AS amount, -cents AS amount_cents,
      label || CASE WHEN k % 3 = 0 THEN ' Mandat: M' || k ELSE '' END
            || CASE WHEN k % 7 = 0 THEN ' Filiale ' || k % 7 ELSE '' END AS description,
      CASE k % 5 WHEN 0 THEN 'rent' WHEN 1 THEN 'shopping' WHEN 2 THEN 'insurance'
                 WHEN 3 THEN 'subscription' ELSE 'other' END AS category,
      CASE WHEN k % 2 = 0 THEN 'R' || k ELSE '' END AS reference,
      CASE WHEN k % 3 = 0 THEN 'M' || k ELSE '' END AS mandate
    FROM ({ORDERS})"""
ORACLES["transactions"] = TRANSACTIONS
ORACLES["transactions_of_lines"] = f"""
    SELECT * EXCLUDE (c, k) REPLACE ('acc-' || c AS doc_id,
      CAST(row_number() OVER (PARTITION BY c ORDER BY k) AS INTEGER) AS txn_no)
    FROM ({TRANSACTIONS.replace("SELECT ", "SELECT c, k, ", 1)})"""
_CATEGORY = " ".join(
    "WHEN " + " OR ".join(f"contains(lower(label), {_q(w)})" for w in words) + f" THEN {_q(name)}"
    for name, words in CATEGORY_KEYWORDS.items()
)
ORACLES["txn_category"] = f"""
    SELECT CASE {_CATEGORY} ELSE 'other' END AS category, count(*) AS n,
           CAST(-sum(cents) AS BIGINT) AS total_cents
    FROM ({ORDERS}) GROUP BY 1"""
ORACLES["category_from_table"] = f"""
    WITH kw AS (SELECT DISTINCT category, 100 - length(w) AS priority, lower(w) AS w FROM (
           SELECT 'item-' || item_id AS category, unnest(regexp_split_to_array(text, '[^\\p{{L}}]+')) AS w FROM benchmark)
         WHERE w <> ''),
    lines AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, {NL}), 1) - 1 AS INTEGER) AS line_no,
                unnest(string_split(text, {NL})) AS line FROM documents),
    best AS (SELECT line, arg_min(category, (priority, category)) AS category
             FROM (SELECT DISTINCT lower(line) AS line FROM lines) JOIN kw ON contains(line, w) GROUP BY line)
    SELECT doc_id, line_no, coalesce(category, 'other') AS category FROM lines LEFT JOIN best ON best.line = lower(lines.line)"""
BALANCE_ROWS = f"""
    SELECT 'st-' || c || '-' || b AS doc_id, (c * 137 + 34) / 100 AS opening_balance,
      CAST(sum(cents) AS BIGINT) / 100 AS closing_balance,
      CASE WHEN c % 3 = 0 THEN 2500.0::DOUBLE END AS overdraft_limit
    FROM ({ORDERS}) GROUP BY c, b"""
ORACLES["balances"] = BALANCE_ROWS
_CELLS = "l_partkey || '|' || CAST(l_quantity AS BIGINT) || '|' || l_returnflag"
_SECOND = "l_suppkey || '|-|' || l_linestatus"
ORACLES["tables_normalise"] = f"""
    SELECT l_orderkey AS doc_id, l_linenumber AS page_no, table_no, row_no,
           'part|qty|flag' AS headers, cells
    FROM (SELECT *, 0 AS table_no, 0 AS row_no, {_CELLS} AS cells FROM lineitem
          UNION ALL SELECT *, 0, 1, {_SECOND} FROM lineitem
          UNION ALL SELECT *, 1, NULL, NULL FROM lineitem WHERE l_linenumber = 1)"""
ORACLES["tables_of_documents"] = f"""
    SELECT l_orderkey AS doc_id, CAST(count(*) + count(*) FILTER (l_linenumber = 1) AS INTEGER) AS n_tables,
           string_agg({_CELLS} || ';' || {_SECOND}, ';'
             ORDER BY l_linenumber, l_partkey::VARCHAR, l_quantity::BIGINT::VARCHAR, l_returnflag,
             l_suppkey::VARCHAR) AS rows
    FROM lineitem GROUP BY l_orderkey"""

# --- attributes ------------------------------------------------------------

_K = "json_extract_string(props, '$.k')"


def _attribute_rows(rows: str) -> str:
    return f"""
    SELECT scope, 'user' || u || '.k' || k AS key, no AS seq,
      CASE no % 3 WHEN 0 THEN k WHEN 1 THEN '[' || k || ',1]' ELSE 'v' || k END AS value,
      CASE WHEN no % 2 = 0 THEN '0' END AS default_value, 'from row ' || no AS description
    FROM ({rows})"""


EVENTS = _attribute_rows(f"SELECT event_type AS scope, user_id AS u, {_K} AS k, event_id AS no FROM events")
CHANGES = _attribute_rows(
    f"SELECT [{', '.join(map(_q, SCOPES))}][o_custkey % 5 + 1] AS scope, o_custkey AS u,"
    " CAST(o_orderkey % 100 AS VARCHAR) AS k, o_orderkey AS no FROM orders"
)
ATTRIBUTES = f"""
    SELECT scope, key, value, default_value, description FROM (
      SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY seq) AS rn
      FROM ({EVENTS})) WHERE rn = 1"""
_ATTR = f"WITH ch AS ({CHANGES}), cur AS ({ATTRIBUTES})"
_LAST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY seq DESC) AS rn
            FROM ch) WHERE rn = 1)"""
_FIRST = """first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY seq) AS rn
            FROM ch) WHERE rn = 1)"""


def _json_or_text(x: str) -> str:
    return f"CASE WHEN json_valid({x}) THEN {x} ELSE '\"' || {x} || '\"' END"


ORACLES["attr_list"] = f"""
    {_ATTR} SELECT scope, key, {_json_or_text('value')} AS value,
      CASE WHEN json_valid(value) THEN default_value ELSE '"' || default_value || '"' END AS default_value,
      CASE WHEN NOT json_valid(value) THEN 'STRING' WHEN value[1] = '[' THEN 'ARRAY<BIGINT>' ELSE 'BIGINT' END
        AS value_type, description FROM cur"""
ORACLES["attr_get"] = f"""
    {_ATTR} SELECT ch.scope, ch.key, seq, coalesce(cur.value, ch.default_value) AS raw,
      CASE WHEN cur.value IS NOT NULL THEN {_json_or_text('cur.value')}
           ELSE '"' || ch.default_value || '"' END AS value
    FROM ch LEFT JOIN cur USING (scope, key) WHERE coalesce(cur.value, ch.default_value) IS NOT NULL"""
ORACLES["attr_get_rejected"] = f"""
    {_ATTR} SELECT ch.scope, ch.key, 'not found' AS reason FROM ch LEFT JOIN cur USING (scope, key)
    WHERE cur.value IS NULL AND ch.default_value IS NULL"""
_COLS = "scope, key, value, default_value, description"
ORACLES["attr_insert"] = f"""
    {_ATTR}, {_FIRST} SELECT {_COLS} FROM cur UNION ALL
    SELECT {_COLS} FROM first ANTI JOIN cur USING (scope, key)"""
ORACLES["attr_insert_rejected"] = f"""
    {_ATTR}, {_FIRST} SELECT scope, key, seq, 'exists' AS reason FROM ch
    WHERE (scope, key) IN (SELECT (scope, key) FROM cur)
       OR seq NOT IN (SELECT seq FROM first)"""
ORACLES["attr_update"] = f"""
    {_ATTR}, {_LAST} SELECT cur.scope, cur.key, coalesce(last.value, cur.value) AS value,
      cur.default_value, cur.description FROM cur LEFT JOIN last USING (scope, key)"""
ORACLES["attr_update_rejected"] = f"""
    {_ATTR} SELECT DISTINCT scope, key, 'missing' AS reason FROM ch ANTI JOIN cur USING (scope, key)"""
ORACLES["attr_reset"] = f"""
    {_ATTR} SELECT scope, key, CASE WHEN default_value IS NOT NULL AND (scope, key) IN (SELECT (scope, key) FROM ch)
      THEN default_value ELSE value END AS value, default_value, description FROM cur"""
ORACLES["attr_reset_rejected"] = f"""
    {_ATTR} SELECT DISTINCT scope, key, 'missing or no default' AS reason FROM ch
    ANTI JOIN (SELECT * FROM cur WHERE default_value IS NOT NULL) USING (scope, key)"""
ORACLES["attr_seed"] = f"""
    {_ATTR} SELECT {_COLS} FROM cur UNION ALL
    SELECT DISTINCT scope, key, '0', '0', 'seeded' FROM ch ANTI JOIN cur USING (scope, key)"""
ORACLES["attr_upsert"] = f"""
    {_ATTR}, {_LAST} SELECT scope, key, coalesce(last.value, cur.value) AS value,
      CASE WHEN cur.value IS NOT NULL THEN cur.default_value ELSE last.default_value END AS default_value,
      CASE WHEN cur.value IS NOT NULL THEN cur.description ELSE last.description END AS description
    FROM cur FULL JOIN last USING (scope, key)"""
_COMMANDS = f"""{_ATTR},
    log AS (SELECT *, ['insert', 'update', 'reset', 'upsert'][seq % 7 % 4 + 1] AS command FROM ch),
    made AS (SELECT scope, key, min(seq) AS made_at FROM log ANTI JOIN cur USING (scope, key)
             WHERE command IN ('insert', 'upsert') GROUP BY ALL),
    state AS (SELECT scope, key, CAST(-1 AS BIGINT) AS made_at, value, default_value, description FROM cur
              UNION ALL SELECT scope, key, made_at, value, default_value, description
              FROM made JOIN log USING (scope, key) WHERE seq = made_at),
    judged AS (SELECT log.scope, log.key, seq, command, log.value AS new_value, state.default_value AS kept_default,
                 CASE WHEN command = 'insert' AND seq > made_at THEN 'exists'
                      WHEN command IN ('update', 'reset') AND (made_at IS NULL OR seq < made_at) THEN 'missing'
                      WHEN command = 'reset' AND state.default_value IS NULL THEN 'no default' END AS reason
               FROM log LEFT JOIN state USING (scope, key)),
    last AS (SELECT scope, key, arg_max(CASE command WHEN 'reset' THEN kept_default ELSE new_value END, seq) AS value
             FROM judged WHERE reason IS NULL AND new_value IS NOT NULL GROUP BY ALL)"""
ORACLES["attr_commands"] = f"""
    {_COMMANDS} SELECT scope, key, coalesce(last.value, state.value) AS value, default_value, description
    FROM state LEFT JOIN last USING (scope, key)"""
ORACLES["attr_commands_rejected"] = f"""
    {_COMMANDS} SELECT scope, key, seq, command, reason FROM judged WHERE reason IS NOT NULL"""
ORACLES["attr_update_typed"] = f"""
    {_ATTR}, {_LAST} SELECT cur.scope, cur.key,
      CASE WHEN last.seq IS NULL THEN cur.value ELSE '[' || seq % 100 || ',' || seq || ']' END AS value,
      cur.default_value, cur.description FROM cur LEFT JOIN last USING (scope, key)"""
_SECRET = """
    SELECT 'customer' || c_custkey AS scope, 'openai.api_key' AS key,
      CASE c_custkey % 3 WHEN 0 THEN 'sk-' WHEN 1 THEN 'org-' ELSE 'key-' END || md5(CAST(c_custkey AS VARCHAR)) AS value
    FROM customer"""
ORACLES["attr_mask"] = (
    f"SELECT scope, key, left(value, 8) || '...' || right(value, 4) AS value FROM ({_SECRET})"
)
ORACLES["attr_validate"] = f"""
    SELECT scope, key, CASE WHEN starts_with(value, 'key-') THEN 'invalid format' ELSE 'ok' END AS reason
    FROM ({_SECRET})"""

# --- AI tables -------------------------------------------------------------

ORACLES["ai_requests"] = f"""
    SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(n AS INTEGER) AS n_chunks,
           {_q(replies.MODEL)} AS model,
           substring(text, (chunk_no - 1) * {replies.INPUT_LIMIT} + 1, {replies.INPUT_LIMIT}) AS user_text,
           CAST({replies.TEMPERATURE} AS DOUBLE) AS temperature, 'json_object' AS response_format
    FROM (SELECT *, unnest(range(1, n + 1)) AS chunk_no FROM (
      SELECT *, CAST(ceil(length(text) / {replies.INPUT_LIMIT}) AS BIGINT) AS n FROM ({PROSE}) WHERE text <> ''))"""


def _ok(x: str) -> str:
    return f"CASE WHEN conv_id % 10 <> 0 THEN {x} END"


_REPLY_ERROR = f"""CASE WHEN conv_id % 20 = 0 THEN {_q(replies.NOT_AN_OBJECT)}
                        WHEN conv_id % 10 = 0 THEN {_q(replies.PARSE_FAILED)} END"""
ORACLES["ai_reply_normalise"] = f"""
    SELECT conv_id AS doc_id, turn, {_REPLY_ERROR} AS error,
      {_ok("CASE WHEN conv_id % 4 <> 0 THEN role ELSE 'unknown' END")} AS document_type,
      {_ok("CASE WHEN conv_id % 4 <> 2 THEN text ELSE '' END")} AS text,
      {_ok("CASE WHEN conv_id % 4 <> 1 THEN 'chat' END")} AS purpose,
      {_ok("CASE WHEN conv_id % 4 <> 3 THEN CAST(turn AS VARCHAR) END")} AS turn_pair,
      {_ok("CASE WHEN conv_id % 4 = 0 THEN 'Person ' || conv_id ELSE '' END")} AS people,
      {_ok("CASE WHEN conv_id % 4 = 1 THEN 'Bank AG|' || role ELSE '' END")} AS organizations,
      {_ok("CASE WHEN conv_id % 4 = 2 THEN '2024-01-31' ELSE '' END")} AS dates,
      {_ok("CASE WHEN conv_id % 4 = 3 THEN '12.50|' || turn ELSE '' END")} AS amounts
    FROM conversations"""
ORACLES["ai_chunked_replies"] = f"""
    WITH ch AS (SELECT doc_id, chunk_no AS c, user_text AS t, length(user_text) % 10 = 3 AS bad
                FROM ({ORACLES["ai_requests"]})),
    names AS (SELECT doc_id, list('P' || p ORDER BY first_c) AS l FROM (
                SELECT doc_id, c % 3 AS p, min(c) AS first_c FROM ch WHERE NOT bad GROUP BY ALL) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN bool_and(bad) THEN {_q(replies.PARSE_FAILED)} END AS error,
      CASE WHEN NOT bool_and(bad) THEN coalesce('type' || min(c) FILTER (NOT bad AND c % 2 = 0), 'unknown') END
        AS document_type,
      md5(string_agg(t, '' ORDER BY c) FILTER (NOT bad)) AS text_md5, 'part ' || max(c) FILTER (NOT bad) AS purpose,
      CASE WHEN NOT bool_and(bad) THEN concat_ws(';', {", ".join(
          f"'k{k}=' || max(c) FILTER (NOT bad AND c % 4 = {k})" for k in range(4))}) END AS pairs,
      CASE WHEN NOT bool_and(bad) THEN
        array_to_string(list_concat([any_value(l)[1], 'Ann'], any_value(l)[2:]), '|') END AS people,
      CASE WHEN NOT bool_and(bad) THEN
        coalesce(string_agg(CAST(c AS VARCHAR), '|' ORDER BY c) FILTER (NOT bad AND c % 2 = 1), '') END AS amounts,
      CAST(count(*) AS INTEGER) AS n_parts, CAST(count(*) FILTER (bad) AS INTEGER) AS n_failed
    FROM ch LEFT JOIN names USING (doc_id) GROUP BY doc_id"""
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
ORACLES["ai_statement_replies"] = f"""
    SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 10 = 0 THEN {_q(replies.PARSE_FAILED)} END AS error,
      CASE WHEN o_orderkey % 10 <> 0 THEN 'Customer ' || o_custkey END AS holder,
      CASE WHEN o_orderkey % 10 <> 0 THEN 'DE89370400440532013000' END AS iban,
      CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS period,
      CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 3 <> 0 THEN {_CENTS} / 100 END AS opening_balance,
      CAST(CASE WHEN o_orderkey % 10 <> 0 THEN CASE WHEN o_orderkey % 4 <> 0 THEN 2 ELSE 0 END END AS INTEGER)
        AS n_transactions
    FROM orders"""
ORACLES["ai_transactions"] = f"""
    SELECT o_orderkey AS doc_id, n AS txn_no, strftime(o_orderdate, '%Y-%m-%d') AS date,
      CASE n WHEN 1 THEN o_orderpriority ELSE 'Gebühr' END AS description,
      CASE n WHEN 1 THEN -{_CENTS} / 100 ELSE -1.5 END AS amount,
      CASE n WHEN 1 THEN 'other' END AS category,
      CASE n WHEN 2 THEN 'R' || o_orderkey END AS reference, CAST(NULL AS VARCHAR) AS mandate
    FROM orders, (VALUES (1), (2)) AS t(n) WHERE o_orderkey % 10 <> 0 AND o_orderkey % 4 <> 0"""

# --- language --------------------------------------------------------------

_GRAMS = """
    SELECT doc_id, lang, substr(t, CAST(i AS BIGINT), 3) AS gram FROM (
      SELECT doc_id, lang, t, unnest(range(1, length(t) - 1)) AS i FROM (
        SELECT 'doc-' || doc_id AS doc_id, lang, regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g') AS t
        FROM documents))"""
_PROFILE = f"""prof AS MATERIALIZED (SELECT lang, gram, CAST(r AS INTEGER) AS rank FROM (
      SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS r
      FROM g GROUP BY lang, gram) WHERE r <= {language.PROFILE_SIZE})"""
ORACLES["language_profiles"] = f"WITH g AS ({_GRAMS}), {_PROFILE} SELECT lang, gram, rank FROM prof"
ORACLES["language_id"] = f"""
    WITH g AS MATERIALIZED ({_GRAMS}), {_PROFILE},
    dp AS (SELECT doc_id, gram, r FROM (
      SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, gram) AS r
      FROM g GROUP BY doc_id, gram) WHERE r <= {language.PROFILE_SIZE}),
    langs AS (SELECT DISTINCT lang FROM prof),
    dist AS (SELECT doc_id, langs.lang, CAST(sum(coalesce(abs(r - rank), {language.PROFILE_SIZE})) AS BIGINT) AS distance
      FROM dp, langs LEFT JOIN prof ON prof.lang = langs.lang AND prof.gram = dp.gram GROUP BY ALL),
    best AS (SELECT doc_id, lang, distance FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS rn FROM dist) WHERE rn = 1)
    SELECT 'doc-' || d.doc_id AS doc_id, coalesce(lang_found, 'en') AS detected, distance,
      CASE WHEN lang_found = 'de' THEN 'deu' ELSE 'eng' END AS ocr_language
    FROM documents d LEFT JOIN (SELECT doc_id, lang AS lang_found, distance FROM best) b
      ON b.doc_id = 'doc-' || d.doc_id"""

# --- records ---------------------------------------------------------------

_TIME = f"CAST({EPOCH + DAY} AS BIGINT) AS processed_s"
_ALL_TURNS = f"""
    SELECT 'doc-' || conv_id AS doc_id, conv_id, arg_min(role, turn) AS role,
      coalesce(string_agg(text, {NL} ORDER BY turn) FILTER (text <> ''), '') AS reply_text,
      max(turn) AS last_turn, string_agg(CAST(turn AS VARCHAR), '|' ORDER BY turn) AS turns,
      conv_id % 10 <> 0 AS ai, any_value({_REPLY_ERROR}) AS err
    FROM (SELECT DISTINCT * FROM conversations) o GROUP BY conv_id"""
ORACLES["records"] = f"""
    WITH {_confidence_ctes(MIXED)},
    zj AS (SELECT doc_id, {_JOINED_ZONES} AS zones_text FROM zt GROUP BY doc_id),
    pairs AS ({_pairs("SELECT doc_id, text FROM docs WHERE doc_type IS NOT NULL", "text")}),
    np AS (SELECT doc_id, count(*) AS n FROM pairs GROUP BY doc_id),
    fl AS ({_fields("docs")}), nf AS (SELECT doc_id, count(*) AS n FROM fl GROUP BY doc_id),
    tx AS ({TRANSACTIONS}), nt AS (SELECT doc_id, count(*) AS n FROM tx GROUP BY doc_id),
    bal AS ({BALANCE_ROWS}),
    seen AS (SELECT conv_id, string_agg(role, '|' ORDER BY first_turn) AS roles FROM (
               SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL) GROUP BY conv_id),
    rp AS (SELECT * FROM ({_ALL_TURNS}) LEFT JOIN seen USING (conv_id)),
    x AS (SELECT docs.*, coalesce(zones_text || substr(text, length(page_text) + 1), text) AS found, conf.c, coalesce(np.n, 0) AS np,
                 coalesce(nf.n, 0) AS nf, coalesce(nt.n, 0) AS nt, bal.closing_balance,
                 conv_id, last_turn, turns, roles, role, reply_text, coalesce(ai, false) AS ai, err
          FROM docs LEFT JOIN zj USING (doc_id) LEFT JOIN conf USING (doc_id) LEFT JOIN np USING (doc_id)
          LEFT JOIN nf USING (doc_id) LEFT JOIN nt USING (doc_id) LEFT JOIN bal USING (doc_id)
          LEFT JOIN rp USING (doc_id))
    SELECT doc_id, sha256(text) AS checksum, {_TIME}, 'archive/' || doc_id AS path,
      CASE WHEN ai AND conv_id % 4 <> 0 THEN role ELSE coalesce(doc_type, 'unknown') END AS type,
      CASE WHEN ai AND conv_id % 4 <> 1 THEN 'chat' ELSE '' END AS purpose, round(c, 6) AS confidence,
      closing_balance,
      md5(CASE WHEN ai AND conv_id % 4 <> 2 AND reply_text <> '' THEN reply_text ELSE found END) AS text_md5,
      CAST(CASE WHEN ai AND conv_id % 4 <> 3 THEN 1 ELSE np END AS INTEGER) AS n_pairs,
      CASE WHEN ai AND conv_id % 4 <> 3 THEN CAST(last_turn AS VARCHAR) END AS last_turn,
      CASE WHEN ai AND conv_id % 4 = 1 THEN 'Bank AG|' || roles ELSE '' END AS organizations,
      CASE WHEN ai AND conv_id % 4 = 0 THEN 'Person ' || conv_id ELSE '' END AS people,
      CASE WHEN ai AND conv_id % 4 = 2 THEN '2024-01-31' ELSE {_bag('text', en.DATE_PATTERNS)} END AS dates,
      CASE WHEN ai AND conv_id % 4 = 3 THEN '12.50|' || turns ELSE {_bag('text', en.AMOUNT_PATTERNS)} END AS amounts,
      CAST(nt AS INTEGER) AS n_transactions,
      CAST(CASE WHEN ai AND conv_id % 4 <> 1 THEN 1 ELSE nf END AS INTEGER) AS n_fields,
      CASE WHEN ai THEN 'ai' ELSE 'traditional' END AS method,
      CASE WHEN ai THEN 'ai' WHEN doc_type IS NOT NULL THEN 'template' ELSE 'basic' END AS branch,
      CASE WHEN text = '' THEN 'No text content available' WHEN conv_id IS NULL
           THEN 'OpenAI client not configured' END AS reason,
      err AS fallback_message
    FROM x"""
ORACLES["basic_records"] = f"""
    SELECT path, sha256(text) AS checksum, 'unknown' AS type, 'traditional' AS method,
      {_strip("regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')")} AS text,
      {_bag("text", [en.BASIC_DATE_PATTERN])} AS dates, {_bag("text", [en.BASIC_AMOUNT_PATTERN])} AS amounts
    FROM ({FILES})"""
ORACLES["failed_records"] = f"""
    SELECT 'event/' || event_id AS path, 'traditional' AS method,
      CASE WHEN q THEN 'RateLimitError' ELSE 'TimeoutError' END AS error_type,
      CASE WHEN q THEN 'Quota exceeded on ' ELSE 'no answer to ' END || event_type AS error_message,
      CASE WHEN q THEN {_q(replies.HINT_QUOTA)} ELSE {_q(replies.HINT_OTHER)} END AS resolution_hint
    FROM (SELECT *, event_type IN ('error', 'click') AS q FROM events)"""
