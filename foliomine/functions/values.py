"""Attribute values: text that is JSON where it parses, plain text otherwise."""

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def encode(value: Column, data_type: DataType) -> Column:
    """Strings stay as they are, everything else becomes JSON text."""
    if isinstance(data_type, (ArrayType, MapType, StructType)):
        return F.to_json(value)
    return value.cast("string")


def decode(value: Column) -> Column:
    """VARIANT: the parsed JSON, else the raw string."""
    return F.coalesce(F.try_parse_json(value), value.cast("variant"))


def decode_pair(value: Column, default: Column) -> tuple[Column, Column]:
    """Value and default of a listing: both are parsed, or both stay raw.

    A missing or empty default does not keep the value from being parsed and
    is listed as NULL then.
    """
    parsed = F.try_parse_json(value)
    parsed_default = F.try_parse_json(default)
    no_default = F.coalesce(default, F.lit("")) == ""
    both = parsed.isNotNull() & (no_default | parsed_default.isNotNull())
    return (
        F.when(both, parsed).otherwise(value.cast("variant")),
        F.when(both, parsed_default).otherwise(default.cast("variant")),
    )


def mask(value: Column) -> Column:
    """First eight and last four characters of a secret."""
    return F.when(
        F.length(value) > 0,
        F.concat(F.left(value, F.lit(8)), F.lit("..."), F.right(value, F.lit(4))),
    ).otherwise(value)


def is_api_key(value: Column) -> Column:
    return value.startswith("sk-") | value.startswith("org-")
