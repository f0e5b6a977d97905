import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).config("spark.driver.memory", "4g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, equal texts, clashing extra columns."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf today"
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    rows = [
        (1, base, "en", "a", 3), (2, base.replace(" ", "\t "), "en", "a", 3), (3, base + " again", "en", "b", 3), (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \n ", "en", None, 3),
        (7, long, "de", "c", 9), (8, long, "de", "c", 9), (9, "two words", None, "a", 2), (9, "two words", None, "a", 2), (None, "no id at all", "en", "b", 1), (None, "no id at all", "en", "b", 1),
        (10, "ünï cödé 日本語 text", "x", "c", 1), (11, base.upper(), "en", "c", 1), (12, "Σας İstanbul don't <|endoftext|> \x1c x", "x", "a", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("size", "keep", "row", "h", "score", "shard", "ids", "place", "target", "label"):
        df = df.selectExpr("*", f"'other' AS {name}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
