import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """Rows ``(doc_id, text)`` of the given texts, numbered."""

    def make(*values):
        return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")

    return make


@pytest.fixture
def evaluate(spark):
    """Value of a column function for each of the given strings."""

    def run(function, *values):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").coalesce(1)
        return [r["y"] for r in rows.orderBy("i").select(function(F.col("x")).alias("y")).collect()]

    return run
