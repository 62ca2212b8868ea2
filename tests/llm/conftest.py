import pytest

ODD_TEXTS = [None, "", " \n\t ", "x", "a b c", "é \U0001f600 İ", "word " * 30000]


@pytest.fixture
def documents(spark):
    """Documents with odd texts, a null id, repeated rows and columns whose names the
    operators use themselves."""
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "x", "en", "s"), (3, "x", "en", "s"), (None, "a text without an id", None, None)]
    rows += [(20 + i, f"the quick brown fox number {i} jumps over it", "en", None) for i in range(6)]
    rows = [(*r, 7, "v", 1.5, "g", True) for r in rows]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, node long, words string, "
        "score double, `group` string, kept boolean",
    )


@pytest.fixture
def none(documents):
    return documents.where("false")


@pytest.fixture
def table(spark):
    def read(name, sf="sf0.001"):
        return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")

    return read
