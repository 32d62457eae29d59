import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use inside.
EXTRA = ", rank int, score double, _bucket string, _n string, quality string, weights string, mix string, site_key string, licence string, component string, node string, text_md5 string"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and names that clash."""
    long = "the same old words again and some more of them " * 3000 + " ".join(f"w{i}" for i in range(20_000))
    rows = [
        (1, "A text of more than ten words that is quite like the others, password = \"hunter2hunter2\"\nLicensed under CC BY-NC 4.0.", "en", "a", 5),
        (2, None, "en", "a", None), (3, "", "de", "b", 0), (None, "no id here but a few words, enough of them to be a text of its own", "fr", "b", 3),
        (4, "   \n\t ", None, None, 4), (5, long, "en", "a", len(long)), (6, "üñí ☃ \U0001f600 x", "es", None, 9), (6, "üñí ☃ \U0001f600 x", "es", None, 9), (7, "123 456", "de", "c", 7), (8, "<|endoftext|> a", "en", "c", 8),
    ]
    extra = (1, 0.5, "b", "n", "q", "w", "m", "s", "l", "c", "n", "t")
    return spark.createDataFrame([r + extra for r in rows], SCHEMA + EXTRA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 9)] + [(None, None, None), (3, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
