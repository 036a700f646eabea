import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, fp string, x string, key string, component string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with those of operators."""
    base = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. "
    texts = [base, base, base.replace("beta", "BETA"), None, "", "   \n", "one", "one two three", base * 400, "x" * 5000, "a " * 3000, "MIXED Case Ünïcödé ß 字 😀 text", "naïve café", base + "lambda", "12345 <|endoftext|> it's", "\x1c\x85 tab\tnew\r\nline"]
    rows = [(i, t, None if i % 3 == 0 else "en", "s", None, -i, "fp", "x", "k", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], rows[3]], SCHEMA)  # two rows twice


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
