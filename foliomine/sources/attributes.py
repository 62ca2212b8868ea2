"""Attribute tables from parquet and from JSON objects keyed by name."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliomine.schema import ATTRIBUTES

_ENTRY = "map<string,struct<value:variant,default:variant,description:string>>"


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ATTRIBUTES).parquet(path)


def read_attribute_lines(spark: SparkSession, path: str) -> DataFrame:
    """Attributes written by :func:`foliomine.operators.attributes.export_json`: JSON
    lines, which split however large the files are."""
    fields = "scope string, key string, stored string, stored_default string, description string"
    rows = spark.read.schema(fields).json(path)
    return rows.select(
        "scope", "key", F.col("stored").alias("value"), F.col("stored_default").alias("default_value"), "description"
    )


def _text_of(value: str):
    """A JSON string gives its characters, any other JSON value its JSON text."""
    is_string = F.schema_of_variant(value) == "STRING"
    return F.when(is_string, F.try_variant_get(F.col(value), "$", "string")).otherwise(
        F.to_json(value)
    )


def read_attribute_json(spark: SparkSession, path: str, scope: str) -> DataFrame:
    """Each file under ``path`` is one JSON object ``{key: {value, default, description}}``."""
    entries = (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json("value", _ENTRY)).alias("key", "entry"))
        .select(
            "key",
            F.col("entry.value").alias("value"),
            F.col("entry.default").alias("default"),
            F.coalesce("entry.description", F.lit("")).alias("description"),
        )
    )
    return entries.select(
        F.lit(scope).alias("scope"),
        "key",
        _text_of("value").alias("value"),
        F.when(~F.is_variant_null("default"), _text_of("default")).alias("default_value"),
        "description",
    )
