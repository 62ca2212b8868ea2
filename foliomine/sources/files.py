"""Files read as rows."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliomine.functions import files as ff
from foliomine.functions.text import strip, unify_newlines

# Schema of Spark's binaryFile source; a stream must be given it.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


# The longest content that Spark's binaryFile source reads; a longer file fails the job.
SOURCE_LIMIT = (1 << 31) - 1


def read_files(
    spark: SparkSession,
    path: str,
    *,
    recursive: bool = True,
    name_glob: str | None = None,
    max_size: int | None = None,
    skip: Callable[[Column], Column] | None = None,
    keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One file or a whole tree as ``(path, modified_at, size, content)``.

    ``max_size``, ``name_glob``, ``skip`` and ``keep`` (tests of the path, such as
    :func:`foliomine.operators.scan.ignored`) are applied by the source, so the
    files they leave out are never opened; :func:`left_out` lists them. There is no
    size limit unless one is given, but that of the source. Select without ``content`` to list only. Spark's
    file source skips names that start with ``.`` or ``_``, and empty files.
    """
    files = _load(spark, path, recursive, name_glob)
    files = files.where(F.col("length") <= _limit(max_size))
    if skip is not None:
        # A filter on the path column is run after the file has been read; one
        # on its metadata is run on the listing.
        files = files.where(~skip(local_path("_metadata.file_path")))
    if keep is not None:
        files = files.where(keep(local_path("_metadata.file_path")))
    return file_columns(files)


def _limit(max_size: int | None) -> int:
    return SOURCE_LIMIT if max_size is None else min(max_size, SOURCE_LIMIT)


def _load(spark: SparkSession, path: str, recursive: bool, name_glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(path)


def left_out(
    spark: SparkSession,
    path: str,
    *,
    recursive: bool = True,
    name_glob: str | None = None,
    max_size: int | None = None,
    skip: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``(path, size, error_type)`` of the files that :func:`read_files` leaves out
    under the same settings: ``IGNORED`` or ``FILE_TOO_LARGE``. Reads the listing alone."""
    location = local_path("_metadata.file_path")
    ignored = F.lit(False) if skip is None else skip(location)
    oversize = F.col("length") > _limit(max_size)
    files = _load(spark, path, recursive, name_glob).where(ignored | oversize)
    return files.select(
        local_path("path").alias("path"),
        F.col("length").alias("size"),
        F.when(ignored, "IGNORED").otherwise("FILE_TOO_LARGE").alias("error_type"),
    )


def local_path(column: str) -> Column:
    return F.regexp_replace(column, "^file:/*", "/")


def file_columns(files: DataFrame) -> DataFrame:
    return files.select(
        local_path("path").alias("path"),
        F.col("modificationTime").alias("modified_at"),
        F.col("length").alias("size"),
        "content",
    )


def with_identity(files: DataFrame) -> DataFrame:
    """Add name, checksum and type, all from one read of the content."""
    return files.select(
        "*",
        ff.base_name(F.col("path")).alias("name"),
        ff.checksum(F.col("content")).alias("checksum"),
        ff.mime_type(F.col("content")).alias("mime_type"),
    )


def decode_text(content: Column) -> Column:
    """Trimmed text of a file, NULL where the bytes are no valid UTF-8."""
    return strip(unify_newlines(F.try_validate_utf8(content.cast("string"))))


def read_text(files: DataFrame, pdf_text: DataFrame | None = None) -> DataFrame:
    """``(path, text, error_type, error_message)`` of every file.

    Text files are decoded; PDF files take their text from ``pdf_text(path,
    text)``, the joined pages of a PDF extractor's output. A file without text
    stays a row that says why.
    """
    is_pdf = ff.is_pdf(F.col("path"))
    decoded = files.where(~is_pdf).select("path", decode_text(F.col("content")).alias("text"))
    pdf = files.where(is_pdf).select("path")
    if pdf_text is None:
        pdf = pdf.withColumn("text", F.lit(None).cast("string"))
    else:
        pdf = pdf.join(pdf_text.select("path", "text"), "path", "left")
    failed = F.col("text").isNull()
    return decoded.unionByName(pdf).select(
        "path",
        "text",
        F.when(failed, "PROCESSING_ERROR").alias("error_type"),
        F.when(failed & ff.is_pdf(F.col("path")), "Failed to extract PDF text")
        .when(failed, "Failed to extract text")
        .alias("error_message"),
    )
