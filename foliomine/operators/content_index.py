"""A search in content that reads the texts of candidates, by an index of trigrams.

The index is written with the texts: ``texts``, the files in parts by file id; ``postings``,
which files hold which trigram; ``grams``, how many files hold each. A search takes the
query's rarest trigram, reads its postings, then only those parts of the texts that have
candidates, and decides there as :func:`foliomine.operators.catalog.search_content` does.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliomine.functions import files as ff
from foliomine.operators import catalog as ca, needles

SEARCHED = ["name", "path", "text"]
PART = "part"
PART_CHARACTERS = 3  # 4,096 parts, evenly full


def with_ids(files: DataFrame) -> DataFrame:
    """Files with ``file_id`` and the part that they are stored in. Rows of one file have one id."""
    identified = files.withColumn("file_id", ff.file_id(F.col("checksum"), F.col("path")))
    return identified.withColumn(PART, F.left("file_id", F.lit(PART_CHARACTERS)))


def postings(files: DataFrame) -> DataFrame:
    """``(gram, part, file_id)`` of each distinct trigram of a file's name, path and text,
    lower-cased, for files of :func:`with_ids`. A file without a text has those of its path."""
    own = F.array_distinct(
        F.concat(*(F.coalesce(needles.grams(F.lower(c), needles.GRAM), F.array()) for c in SEARCHED))
    )
    return files.select(F.explode(own).alias("gram"), PART, "file_id").distinct()


def gram_counts(index: DataFrame) -> DataFrame:
    """``(gram, n_files)``, counted before the shuffle: a gram of all files is no hot key."""
    return index.groupBy("gram").agg(F.count("*").alias("n_files"))


def query_grams(spark: SparkSession, query: str) -> list[str]:
    """The trigrams that every file found by ``query`` holds: those between its wildcards. The
    query is lower-cased by Spark, as a whole, just as the comparison does it."""
    pieces = F.split(F.lower(F.lit(query)), "[%_]")
    own = F.array_distinct(F.flatten(F.transform(pieces, lambda p: needles.grams(p, needles.GRAM))))
    return spark.range(1).select(own.alias("grams")).first()["grams"]


def candidates(index: DataFrame, counts: DataFrame, grams: list[str]) -> DataFrame:
    """``(part, file_id)`` of the files that hold the rarest of those ``grams`` that any file
    holds. That gram is a scalar subquery: it reaches the scan of the postings as a
    filter, whatever number of files there are."""
    asked = counts.where(F.col("gram").isin(grams))
    rarest = asked.orderBy("n_files", "gram").limit(1).select("gram")
    return index.where(F.col("gram") == rarest.scalar()).select(PART, "file_id")


def candidates_at_once(index: DataFrame, counts: DataFrame, grams: list[str]) -> DataFrame:
    """:func:`candidates` of an index that is computed, not read, whose ``counts`` are
    :func:`gram_counts` of it: the texts give out their grams once, for both. The postings of
    all ``grams`` are kept until the rarest is known, so both meet in one shuffle.

    The count keeps Spark from asking for the rarest gram before that shuffle, and values that
    cannot be null from a filter there that ``counts`` has not: the shuffles would differ."""
    is_asked = F.col("gram").isin(grams)
    rarest = counts.where(is_asked).orderBy("n_files", "gram").limit(1).select("gram")
    n = F.count_if(F.col("gram") == rarest.scalar())
    held = index.where(is_asked).groupBy(PART, "file_id").agg(n.alias("n")).where("n > 0")
    return held.select(*(F.coalesce(c, F.lit("")).alias(c) for c in (PART, "file_id")))


def search(
    files: DataFrame,
    index: DataFrame,
    counts: DataFrame,
    query: str,
    limit: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """The rows of :func:`foliomine.operators.catalog.search_content`, in its order, from the
    files of :func:`with_ids`, their :func:`postings` and :func:`gram_counts`.

    A query without three characters in a row between its wildcards has no trigram; it goes
    over all files. Rows that repeat are found as often as they are there. Of a ``stored``
    index only the postings of one gram are read; one that is computed is computed once.
    """
    grams = query_grams(files.sparkSession, query)
    if grams:
        found = (candidates if stored else candidates_at_once)(index, counts, grams)
        files = files.join(found, [PART, "file_id"], "left_semi")
    return ca.search_content(files.drop(PART, "file_id"), query, limit=limit)


def write_index(files: DataFrame, path: str) -> None:
    """Write texts, postings and counts of ``files`` under ``path``. Parts and grams that hold
    many rows are spread over several files."""
    spark = files.sparkSession
    (
        with_ids(files)
        .hint("rebalance", PART)
        .sortWithinPartitions(PART, "file_id")
        .write.mode("overwrite")
        .partitionBy(PART)
        .parquet(f"{path}/texts")
    )
    # Part names such as 012 are no numbers, so the stored layout is given.
    texts = read_texts(spark, path, files)
    (
        postings(texts)
        .repartitionByRange("gram", "file_id")
        .sortWithinPartitions("gram", "file_id")
        .write.mode("overwrite")
        .parquet(f"{path}/postings")
    )
    counts = gram_counts(spark.read.parquet(f"{path}/postings"))
    counts.sort("gram").write.mode("overwrite").parquet(f"{path}/grams")


def read_texts(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored texts, in the columns of :func:`with_ids` of ``like``."""
    return spark.read.schema(with_ids(like).schema).parquet(f"{path}/texts")


def search_written(like: DataFrame, path: str, query: str, limit: int | None = None) -> DataFrame:
    """:func:`search` in an index of :func:`write_index`; ``like`` is any table, even an
    empty one, with the columns that were written."""
    spark = like.sparkSession
    index, counts = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "grams"))
    return search(read_texts(spark, path, like), index, counts, query, limit, stored=True)
