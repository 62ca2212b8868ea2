"""The file catalog: build, upsert, look up, search, export, delete, count.

A catalog row is unique by ``(checksum, path)``. One content may sit at very
many paths and one file may be indexed very many times, so rows of one key are
always reduced by an aggregate, which combines before its shuffle, never by a
window over the key.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from foliomine.functions import files as ff
from foliomine.schema import CATALOG, PUBLIC_FILE_COLUMNS

KEY = ["checksum", "path"]


def catalog_rows(files: DataFrame) -> DataFrame:
    """Catalog rows of ``files(checksum, name, size, path, mime_type, created_at,
    batch_no)``, with their ids."""
    identified = files.withColumn("file_id", ff.file_id(F.col("checksum"), F.col("path")))
    return identified.select(*[F.col(f.name).cast(f.dataType) for f in CATALOG])


def _newest(catalog: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in catalog.columns if c not in keys]
    # The batch comes first: a file restored with an old time is still the newest.
    newest = F.max(F.struct("batch_no", "created_at", *[c for c in rest if c not in ("created_at", "batch_no")]))
    return (
        catalog.groupBy(*keys)
        .agg(newest.alias("row"))
        .select(*[c if c in keys else f"row.{c}" for c in catalog.columns])
    )


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Current rows and incoming rows, the newest per key kept."""
    return _newest(current.unionByName(incoming), KEY)


def newest_per_key(changes: DataFrame) -> DataFrame:
    """The catalog that a log of upserts adds up to."""
    return _newest(changes, KEY)


def distinct_files(files: DataFrame) -> DataFrame:
    """One row per key of a batch, the newest."""
    return _newest(files, KEY)


def latest_by_path(catalog: DataFrame) -> DataFrame:
    """The newest content of each path; older contents are left out."""
    return _newest(catalog, ["path"])


def public(catalog: DataFrame) -> DataFrame:
    return catalog.select(*PUBLIC_FILE_COLUMNS)


def _once(requests: DataFrame, key: str) -> DataFrame:
    """Each requested key once: a key asked for very often is no hot join key."""
    return requests.select(key).distinct()


def by_id(catalog: DataFrame, file_id: str) -> DataFrame:
    return catalog.where(F.col("file_id") == file_id)


def by_ids(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of many ids at once; an id may be asked for any number of times."""
    return catalog.join(_once(ids, "file_id"), "file_id", "left_semi")


def first_per_checksum(catalog: DataFrame) -> DataFrame:
    """One row per content: the one cataloged first, ties by path."""
    rest = [c for c in catalog.columns if c not in ("checksum", "created_at", "path")]
    first = F.min(F.struct("created_at", "path", *rest))
    return (
        catalog.groupBy("checksum")
        .agg(first.alias("row"))
        .select(*[c if c == "checksum" else f"row.{c}" for c in catalog.columns])
    )


def by_checksum(catalog: DataFrame, checksum: str) -> DataFrame:
    return first_per_checksum(catalog.where(F.col("checksum") == checksum))


def by_checksums(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """First row of every requested content.

    The requests, each once, filter the catalog before its rows are reduced to one
    per content; Spark broadcasts them where its size check allows.
    """
    found = catalog.join(_once(requests, "checksum"), "checksum", "left_semi")
    return first_per_checksum(found)


def missing_checksums(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested checksums that no file has."""
    return _once(requests, "checksum").join(_once(catalog, "checksum"), "checksum", "left_anti")


def _contains_pattern(query: str) -> str:
    # ``%`` and ``_`` of the query stay wildcards; a backslash is an ordinary character.
    return "%" + query.replace("\\", "\\\\") + "%"


def _hit_pattern(query: str) -> str:
    """What one hit of the query is in a text, wildcards included."""
    parts = {"%": ".*?", "_": "."}
    return "(?isu)" + "".join(parts.get(c) or re.escape(c) for c in query)


def matches_name_or_path(query: str) -> Column:
    """The name is the end of the path, so the path alone decides. It is a key of the
    catalog, so the test goes below the catalog's aggregate."""
    return F.col("path").ilike(_contains_pattern(query))


def newest_first(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("created_at"), "path", "checksum")


def search(catalog: DataFrame, query: str) -> DataFrame:
    """Files whose name or path contains ``query``, newest first."""
    return newest_first(catalog.where(matches_name_or_path(query)))


def search_content(
    catalog: DataFrame, query: str, text: str = "text", limit: int | None = None
) -> DataFrame:
    """Search in name, path and text, best hit first.

    A hit in the name ranks above one in the path above one in the text only;
    within a rank more hits in the text come first. An empty query finds every file,
    with no hits.
    """
    like = _contains_pattern(query)
    in_name, in_path, in_text = (F.col(c).ilike(like) for c in ("name", "path", text))
    hits = F.regexp_count(text, F.lit(_hit_pattern(query))) if query.strip("%") else F.lit(0)
    ranked = (
        catalog.where(in_name | in_path | in_text)
        .withColumn("rank", F.when(in_name, 3).when(in_path, 2).otherwise(1))
        .withColumn("hits", hits.cast("bigint"))
        .drop(text)
        .orderBy(F.desc("rank"), F.desc("hits"), F.desc("created_at"), "path", "checksum")
    )
    return ranked if limit is None else ranked.limit(limit)


def statistics(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
    )


def delete(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    return catalog.join(_once(ids, "file_id"), "file_id", "left_anti")


def unknown_ids(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids asked to be deleted that the catalog does not have."""
    return _once(ids, "file_id").join(catalog, "file_id", "left_anti")


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Ranges of checksums, sorted: a checksum filter reads few row groups."""
    (
        catalog.repartitionByRange("checksum", "path")
        .sortWithinPartitions("checksum", "path")
        .write.mode("overwrite")
        .parquet(path)
    )


# A catalog in parts: one folder per first characters of the checksum.
PART = "part"
PART_CHARACTERS = 2  # 256 parts, evenly full


def _with_part(rows: DataFrame) -> DataFrame:
    return rows.withColumn(PART, F.left("checksum", F.lit(PART_CHARACTERS)))


def write_parts(catalog: DataFrame, path: str) -> None:
    """Write the parts that ``catalog`` has rows of, whole, each sorted by checksum. Other
    parts under the path stay as they are, their files untouched."""
    (
        _with_part(catalog)
        .repartition(PART)
        .sortWithinPartitions(PART, "checksum", "path")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PART)
        .parquet(path)
    )


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*CATALOG, T.StructField(PART, T.StringType())])
    return spark.read.schema(schema).parquet(path)


def upsert_parts(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """:func:`upsert` into a catalog of :func:`write_parts`: the parts of the incoming
    checksums are read, merged and rewritten. The batch runs again with the same result."""
    parts = {r[0] for r in _with_part(incoming).select(PART).distinct().collect()}  # 256 at most
    known = read_parts(spark, path).where(F.col(PART).isin(*parts)).drop(PART)
    write_parts(upsert(known, incoming), path)


def delete_parts(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """:func:`delete` from a catalog of :func:`write_parts`: of the others no file changes.
    A part that loses its last row stays as a folder without rows."""
    catalog = read_parts(spark, path)
    hit = catalog.select("file_id", PART).join(_once(ids, "file_id"), "file_id", "left_semi")
    parts = {r[0] for r in hit.select(PART).distinct().collect()}  # 256 at most
    left = delete(catalog.where(F.col(PART).isin(*parts)), ids)
    full = {r[0] for r in left.select(PART).distinct().collect()}
    write_parts(left.drop(PART), path)
    for part in sorted(parts - full):
        catalog.drop(PART).limit(0).write.mode("overwrite").parquet(f"{path}/{PART}={part}")


def contents(
    catalog: DataFrame, requests: DataFrame, stored: DataFrame, content: str = "content"
) -> DataFrame:
    """``(checksum, path, content)`` of every requested content, once, from
    ``stored(path, content)``: the files themselves or a table of their texts.

    Paths are looked up first, so only the contents asked for are moved. A path of
    several contents, as in a table of texts, is told apart by its checksum.
    """
    found = by_checksums(catalog, requests).select("checksum", "path")
    rows = stored.select("path", F.col(content).alias("content")).join(found, "path")
    same = rows.where(ff.checksum(F.col("content")) == F.col("checksum"))
    once = same.groupBy("checksum", "path").agg(F.any_value("content").alias("content"))
    return once.select("checksum", "path", "content")


def export(
    catalog: DataFrame, requests: DataFrame, stored: DataFrame, path: str, content: str = "content"
) -> DataFrame:
    """Write the requested contents to ``path``; returns the checksums not found."""
    contents(catalog, requests, stored, content).write.mode("overwrite").parquet(path)
    return missing_checksums(catalog, requests)
