import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the quick brown fox jumps over the lazy dog and then runs far away from all of the other animals near a river"


@pytest.fixture(scope="session")
def tables(spark, sf):
    return {name: spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "pages", "benchmark")}


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 5003} {BASE.split()[i % 22]}" for i in range(60_000))
    return [
        (1, BASE, "en", "a", 5), (2, BASE, "en", "a", 5), (2, BASE, "en", "a", 5), (3, None, "en", "b", None),
        (4, "", "de", None, 0), (None, BASE + " again", None, "a", 1), (5, " \n\t ", "de", "b", 3),
        (6, long, "en", "b", len(long)), (7, "12345 67890 !!!", None, "c", 1), (None, None, None, None, None),
        (8, "Ça été déjà où l'hôtel " * 30, "fr", "c", 7), (9, "mail me at jo@ex.org or +1 (555) 010-9999", "en", "c", 1),
        (6, long + " tail", "en", "b", 1), (10, "x", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns of names that the operators use themselves."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(odd_rows, DOCUMENTS)
    for name in ("size", "shard", "row", "spans", "fp", "n", "kept", "component_id", "positions", "_doc", "score", "term"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
