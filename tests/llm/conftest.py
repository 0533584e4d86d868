import tempfile

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    """A folder of its own for this session, as a cluster would name it."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="llm-tests-"))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    long = "the quick brown fox jumps over the lazy dog and runs away. " * 4000
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 4), (4, long, "en", None, len(long)),
        (5, "One small step for a man, one giant leap.", "en", "b", None), (5, "One small step for a man, one giant leap.", "en", "b", None),
        (None, "No id at all here", None, None, None), (6, "héé ñandú straße 123 <|endoftext|> it's   x", "de", "c", 9),
        (7, "aaaa" * 300, "fr", "c", 1200), (8, "!!! ### 12 34", "en", "d", 13), (9, long, "en", "d", len(long)),
        (10, "x", "en", "d", 1), (None, None, None, None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    clash = ["_text", "_id", "score", "key", "who", "node", "fp", "table", "_new", "_words", "stratum", "bytes", "row", "spans",
             "_slot", "_first", "toxic", "word", "start", "_lines", "anchor"]
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("other") for c in clash})


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
