"""Index files as they arrive.

Each micro-batch writes its upserts as one directory of a change log, named by
the batch number. A batch that is run again after a failure writes the same
directory again, so nothing is cataloged twice; the catalog is never rewritten
per batch. It is the newest row per key of the log, and ``compact`` folds the
log into one directory now and then.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from foliomine.operators import catalog, scan
from foliomine.schema import CATALOG
from foliomine.sources import files as src


ARRIVAL = "path string, size long, modified_at timestamp, error_type string"


def _catalog_rows(files: DataFrame, batch_no: int) -> DataFrame:
    kept = files.where(~scan.ignored(F.col("path")))
    rows = src.with_identity(kept).select(
        "checksum",
        "name",
        "size",
        "path",
        "mime_type",
        F.col("modified_at").alias("created_at"),
        F.lit(batch_no).cast("bigint").alias("batch_no"),
    )
    return catalog.catalog_rows(rows)


def write_batch(files: DataFrame, batch_no: int, log: str) -> None:
    """Write the catalog rows of one batch under its number."""
    _catalog_rows(files, batch_no).write.mode("overwrite").parquet(f"{log}/batch={batch_no}")


def index_files(
    spark: SparkSession,
    source: str,
    log: str,
    checkpoint: str,
    max_size: int | None = None,
    files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Catalog every file under ``source`` that is new since the last run. Files that are
    ignored, larger than ``max_size`` or than the source reads, gone or unreadable stay out of
    the catalog and stop nothing; :func:`log_arrivals` and :func:`rejected` list them."""
    reader = spark.readStream.schema(src.BINARY_FILE).format("binaryFile")
    arrivals = (
        reader.option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .load(source)
        .where(F.col("length") <= (src.SOURCE_LIMIT if max_size is None else min(max_size, src.SOURCE_LIMIT)))
        .where(~scan.ignored(src.local_path("_metadata.file_path")))
    )
    return (
        src.file_columns(arrivals)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda files, batch_no: write_batch(files, batch_no, log))
        .trigger(availableNow=True)
        .start()
    )


def log_arrivals(
    spark: SparkSession,
    source: str,
    arrivals: str,
    checkpoint: str,
    max_size: int | None = None,
    files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Log ``path, size, modified_at, error_type`` of every file under ``source`` that is
    new since the last run: ``IGNORED``, ``FILE_TOO_LARGE`` or NULL for one to be cataloged.

    It reads the listing and no content. Each batch overwrites its own directory, so one
    that is run again changes nothing.
    """
    reader = spark.readStream.schema(src.BINARY_FILE).format("binaryFile")
    location = src.local_path("path")
    limit = src.SOURCE_LIMIT if max_size is None else min(max_size, src.SOURCE_LIMIT)
    listed = (
        reader.option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(source)
        .select(
            location.alias("path"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified_at"),
            F.when(scan.ignored(location), "IGNORED")
            .when(F.col("length") > limit, "FILE_TOO_LARGE")
            .alias("error_type"),
        )
    )

    def write(files: DataFrame, batch_no: int) -> None:
        files.write.mode("overwrite").parquet(f"{arrivals}/batch={batch_no}")

    return (
        listed.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def rejected(spark: SparkSession, arrivals: str, log: str) -> DataFrame:
    """``(path, size, error_type)`` of the arrivals that are not in the catalog's log,
    ``UNREADABLE`` being those that should be: both queries have run to the end."""
    listed = spark.read.schema(ARRIVAL).option("recursiveFileLookup", True).parquet(arrivals)
    newest = listed.groupBy("path").agg(F.max(F.struct("modified_at", "size", "error_type")).alias("a"))
    cataloged = read_log(spark, log).select("path").distinct()
    left = newest.select("path", "a.size", "a.error_type")
    unreadable = left.where("error_type is null").join(cataloged, "path", "left_anti")
    return left.where("error_type is not null").unionByName(
        unreadable.withColumn("error_type", F.lit("UNREADABLE"))
    )


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return (
        spark.read.schema(CATALOG).option("recursiveFileLookup", True).parquet(log)
    )


def current_catalog(spark: SparkSession, log: str) -> DataFrame:
    return catalog.newest_per_key(read_log(spark, log))


def compact(spark: SparkSession, log: str, target: str) -> None:
    """Write the catalog the log adds up to as a new log of one directory."""
    catalog.write_catalog(current_catalog(spark, log), f"{target}/batch=compacted")
