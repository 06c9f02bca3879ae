import pytest
from pyspark.sql import functions as F

NAMES = ["_id", "id", "label", "count", "_row", "_bucket", "key", "low", "high", "hub", "shard", "hash", "vector", "start", "doc_id_", "html_", "n_tokens", "_w", "weight", "component", "kept"]

LONG = " ".join(f"word{i * i % 9973}" for i in range(60_000))
SECRET = "q7Zk29XvT1mB84LsR3yW"
PASSAGE = "the quick brown fox jumps over the lazy dog near the quiet river bank today"
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, f"password {SECRET} stays here"),
    (7, f"password {SECRET} stays here"),
    (None, f"nameless {SECRET} text"),
    (None, PASSAGE),
    (8, f"It says: {PASSAGE.upper()}!"),
    (9, "!!! ??? ..."),
    (10, "ünïcödé wörds straße 漢字 かな текст"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names operators might use."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df = df.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({n: F.when(F.col("doc_id") % 3 == 0, F.lit(n)) for n in NAMES})


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
