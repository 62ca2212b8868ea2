"""Language of a text by ranked character trigrams (Cavnar and Trenkle, 1994).

A language's profile lists its most frequent trigrams in order. A document gets
the language whose profile its own ranked trigrams differ from least.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliomine.functions.text import all_matches

PROFILE_SIZE = 300
MAX_LANGUAGES = 200
FALLBACK_LANGUAGE = "en"


def trigrams(text: Column) -> Column:
    """All overlapping trigrams of the lower-cased text, everything between two
    runs of letters being one space."""
    letters = F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")
    return all_matches(letters, r"(?s)(?=(...))", 1)


def few_languages(labelled: DataFrame) -> bool:
    """Whether ``labelled`` has at most ``MAX_LANGUAGES`` labels, so that its profiles may be
    broadcast."""
    found = labelled.select("lang").where("lang is not null").distinct().limit(MAX_LANGUAGES + 1)
    return found.count() <= MAX_LANGUAGES


def profiles(labelled: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """``(lang, gram, rank)`` from ``labelled(lang, text)``: the ``size`` most
    frequent trigrams per language, ties in gram order.

    Trigrams are counted before the shuffle, so a language that holds most of
    the text moves no more rows than any other; the rank limit is likewise
    applied on both sides of the second shuffle.
    """
    counts = (
        labelled.select("lang", F.explode(trigrams(F.col("text"))).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= size)
        .select("lang", "gram", "rank")
    )


def ranked_trigrams(text: Column, size: int = PROFILE_SIZE) -> Column:
    """The text's own profile, in rank order, computed inside its row: the
    sorted trigrams are joined, each run of one trigram is a match, and the
    longest runs come first."""
    in_order = F.array_join(F.sort_array(trigrams(text)), "")
    runs = F.transform(
        all_matches(in_order, r"(?s)(...)\1*"),
        lambda run: F.struct((-F.length(run)).alias("rank"), F.left(run, F.lit(3)).alias("gram")),
    )
    return F.transform(F.slice(F.sort_array(runs), 1, size), lambda r: r["gram"])


def detect(
    documents: DataFrame, profiles: DataFrame, few: bool = False, size: int = PROFILE_SIZE
) -> DataFrame:
    """``(doc_id, detected, distance)`` by ``profiles`` of any number of languages.

    ``few`` says that the profiles are those of :func:`few_languages` and are
    broadcast; otherwise Spark chooses the join. A document's rows meet in the partial
    aggregate of its own task, then one row per document and language is shuffled.
    Of equally near languages the first by name is taken. Text without a trigram and
    an empty table of profiles give the fallback language and no distance; rows of one
    doc_id count as one document. Profiles without language are left out.

    A gram that a profile has counts for the difference of its ranks, any other one
    ``size``. So each document starts with ``size`` per gram for every language, in a row
    of the empty gram that stands behind its own grams, and each gram found takes off.
    """
    known = profiles.where("lang is not null").select(
        "lang",
        "rank",
        F.explode(
            F.when(F.col("rank") == 1, F.array("gram", F.lit(""))).otherwise(F.array("gram"))
        ).alias("gram"),
    )
    grams = F.concat(F.coalesce(ranked_trigrams(F.col("text"), size), F.array()), F.array(F.lit("")))
    ranked = documents.select("doc_id", F.posexplode_outer(grams).alias("pos", "gram"))
    joined = ranked.join(F.broadcast(known) if few else known, "gram", "left")
    start = F.col("gram") == ""
    difference = F.when(start, F.col("pos") * size).otherwise(F.abs(F.col("pos") + 1 - F.col("rank")) - size)
    per_language = joined.groupBy("doc_id", "lang").agg(
        F.sum(difference).alias("distance"), F.max(F.when(start, F.col("pos"))).alias("grams")
    )
    counted = F.col("lang").isNotNull() & (F.col("grams") > 0)
    nearest = per_language.groupBy("doc_id").agg(
        F.min(F.when(counted, F.struct("distance", "lang"))).alias("best")
    )
    return nearest.select(
        "doc_id",
        F.coalesce("best.lang", F.lit(FALLBACK_LANGUAGE)).alias("detected"),
        F.col("best.distance").alias("distance"),
    )


def ocr_language(lang: Column) -> Column:
    return F.when(lang == "de", "deu").otherwise("eng")
