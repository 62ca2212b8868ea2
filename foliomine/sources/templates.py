"""Document templates: small definitions that every job carries as literals."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

# A template set is configuration. Its patterns become literals of one
# projection, so it is read through this check and never grows with the data.
MAX_PATTERNS = 2_000


@dataclass(frozen=True)
class Zone:
    """Part of page one: relative bounds (x1, y1, x2, y2) and the patterns sought there."""

    name: str
    bounds: tuple[float, float, float, float]
    content_type: str
    patterns: list[str]
    required: bool = False


@dataclass(frozen=True)
class Template:
    name: str
    identifiers: list[str]
    zones: list[Zone] = field(default_factory=list)
    fields: dict[str, str] = field(default_factory=dict)


# The two built-in document types. The address pattern finds what
# ``[letters]+[^\n]+`` in its place finds: the rest of the line decides nothing,
# so it is taken possessively instead of being given back letter by letter.
BUILTIN_TEMPLATES = [
    Template(
        name="bank_statement",
        identifiers=[r"Kontoauszug", r"Girokonto", r"ING-DiBa AG"],
        zones=[
            Zone(
                name="header",
                bounds=(0, 0, 1, 0.2),
                content_type="metadata",
                patterns=[
                    r"Girokonto\s+(?:Nummer|Nr\.?)\s*(\d+)",
                    r"IBAN[:\s]+([A-Z]{2}\d{2}\s*(?:\d{4}\s*){4,7})",
                    r"BIC[:\s]+([A-Z0-9]{8,11})",
                    r"Kontoauszug\s+([A-Za-zäöüÄÖÜß]+\s+\d{4})",
                    r"Auszugsnummer\s+(\d+)",
                    r"Datum\s+(\d{2}\.\d{2}\.\d{4})",
                ],
                required=True,
            ),
            Zone(
                name="balance",
                bounds=(0, 0.1, 1, 0.4),
                content_type="metadata",
                patterns=[
                    r"Alter Saldo\s+([\d.,]+)\s*Euro",
                    r"Neuer Saldo\s+([\d.,]+)\s*Euro",
                    r"Eingeräumte Kontoüberziehung\s+([\d.,]+)\s*Euro",
                ],
                required=True,
            ),
            Zone(
                name="transactions",
                bounds=(0, 0.2, 1, 1),
                content_type="table",
                patterns=[
                    r"(\d{2}\.\d{2}\.\d{4})\s+([^-\d].*?)(?:\s+|$)(?:[-\d.,]+)?\s*$",
                    r"Buchung\s+(?:\/\s*)?Verwendungszweck\s+Betrag\s*\(EUR\)",
                    r"Mandat:([^\n]+)",
                    r"Referenz:([^\n]+)",
                ],
                required=True,
            ),
        ],
        fields={
            "account_number": r"Girokonto\s+(?:Nummer|Nr\.?)\s*(\d+)",
            "iban": r"IBAN[:\s]+([A-Z]{2}\d{2}\s*(?:\d{4}\s*){4,7})",
            "bic": r"BIC[:\s]+([A-Z0-9]{8,11})",
            "statement_period": r"Kontoauszug\s+([A-Za-zäöüÄÖÜß]+\s+\d{4})",
            "statement_number": r"Auszugsnummer\s+(\d+)",
        },
    ),
    Template(
        name="fee_statement",
        identifiers=[
            r"Entgeltaufstellung",
            r"Entgelt-\s*und\s*Zinsübersicht",
            r"gezahlte\s+Entgelte",
        ],
        zones=[
            Zone(
                name="header",
                bounds=(0, 0, 1, 0.2),
                content_type="metadata",
                patterns=[
                    r"Kontobezeichnung\s+([^\n]+)",
                    r"Kontokennung\s+([A-Z]{2}\d{2}\s*(?:\d{4}\s*){4,7})",
                    r"Zeitraum\s+Von\s+(\d{2}\.\d{2}\.\d{4})\s+bis\s+(\d{2}\.\d{2}\.\d{4})",
                    r"Datum\s+(\d{2}\.\d{2}\.\d{4})",
                ],
                required=True,
            ),
            Zone(
                name="account_holder",
                bounds=(0, 0.1, 0.5, 0.3),
                content_type="metadata",
                patterns=[
                    r"([A-Za-zäöüÄÖÜß]+\s+[A-Za-zäöüÄÖÜß]+)\s*\n",
                    r"([A-Za-zäöüÄÖÜß][^\n]++)\s*\n\d{5}\s+[A-Za-zäöüÄÖÜß]+",
                ],
                required=True,
            ),
            Zone(
                name="summary",
                bounds=(0, 0.2, 1, 0.4),
                content_type="amount",
                patterns=[
                    r"Insgesamt\s+gezahlte\s+Entgelte\s*(-?[\d.,]+)\s*EUR",
                    r"Insgesamt\s+gezahlte\s+Zinsen\s*(-?[\d.,]+)\s*EUR",
                    r"Insgesamt\s+erhaltene\s+Zinsen\s*(-?[\d.,]+)\s*EUR",
                ],
                required=True,
            ),
            Zone(
                name="fees",
                bounds=(0, 0.4, 1, 0.9),
                content_type="table",
                patterns=[
                    r"Dienst\s+Entgelt",
                    r"Dienstleistungspaket\s+Entgelt",
                    r"(\d+,\d{2})\s*EUR",
                ],
                required=True,
            ),
        ],
        fields={
            "account_type": r"Kontobezeichnung\s+([^\n]+)",
            "iban": r"Kontokennung\s+([A-Z]{2}\d{2}\s*(?:\d{4}\s*){4,7})",
            "period_start": r"Zeitraum\s+Von\s+(\d{2}\.\d{2}\.\d{4})",
            "period_end": r"Zeitraum\s+Von\s+\d{2}\.\d{2}\.\d{4}\s+bis\s+(\d{2}\.\d{2}\.\d{4})",
            "statement_date": r"Datum\s+(\d{2}\.\d{2}\.\d{4})",
            "account_holder": r"([A-Za-zäöüÄÖÜß]+\s+[A-Za-zäöüÄÖÜß]+)\s*\n",
            "address": r"([A-Za-zäöüÄÖÜß][^\n]++)\s*\n\d{5}\s+[A-Za-zäöüÄÖÜß]+",
            "total_fees": r"Insgesamt\s+gezahlte\s+Entgelte\s*(-?[\d.,]+)\s*EUR",
            "total_interest_paid": r"Insgesamt\s+gezahlte\s+Zinsen\s*(-?[\d.,]+)\s*EUR",
            "total_interest_received": r"Insgesamt\s+erhaltene\s+Zinsen\s*(-?[\d.,]+)\s*EUR",
        },
    ),
]

# One row per template, in the order of ``template_no``; ties in classification
# go to the lower number.
TEMPLATE_ROW = (
    "template_no int, name string, identifiers array<string>, "
    "zones array<struct<name:string,bounds:array<double>,content_type:string,"
    "patterns:array<string>,required:boolean>>, "
    "fields array<struct<key:string,pattern:string>>"
)


def template_rows(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """Templates as a table, ready for ``write.json`` or ``write.parquet``."""
    rows = [
        (
            no,
            t.name,
            t.identifiers,
            [(z.name, [float(b) for b in z.bounds], z.content_type, z.patterns, z.required) for z in t.zones],
            list(t.fields.items()),
        )
        for no, t in enumerate(templates)
    ]
    return spark.createDataFrame(rows, TEMPLATE_ROW)


def templates_from(table: DataFrame, max_patterns: int = MAX_PATTERNS) -> list[Template]:
    """User templates from a table in the layout of :func:`template_rows`.

    Refuses a table that does not fit a plan; for such a table there are
    :func:`foliomine.operators.templates.classify_from` and ``fields_from``, which join it.
    """
    in_zones = F.aggregate("zones", F.lit(0), lambda n, z: n + F.size(z["patterns"]))
    n_patterns = F.size("identifiers") + F.size("fields") + in_zones
    size = table.agg(F.count("*").alias("n"), F.sum(n_patterns).alias("patterns")).first()
    if size["n"] > max_patterns or (size["patterns"] or 0) > max_patterns:
        raise ValueError(f"more than {max_patterns} template patterns")
    rows = table.orderBy("template_no").collect()
    return [
        Template(
            name=r["name"],
            identifiers=list(r["identifiers"]),
            zones=[
                Zone(z["name"], tuple(z["bounds"]), z["content_type"], list(z["patterns"]), z["required"])
                for z in r["zones"]
            ],
            fields={f["key"]: f["pattern"] for f in r["fields"]},
        )
        for r in rows
    ]
