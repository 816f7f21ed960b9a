import pytest

WORDS = "the of and to in a thing ring stone water light over under green river house".split()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing names."""
    long = " ".join(WORDS[i * i % 16] + str(i % 97) for i in range(60_000))
    text = " ".join(WORDS[i * 7 % 16] for i in range(80))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, text, "en", "b", 9), (5, text, "en", None, 9), (5, text, "en", None, 9),
        (5, text, "en", None, 9), (None, text, "en", "b", 1), (None, None, None, None, None), (6, long, "fr", "a", 1), (7, "Ünïcode ñandú 🎉 ça", "fr", "a", 3), (8, "x", "de", "c", 1), (9, "one two", "en", "c", 7), (-3, text + " end", "en", "b", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("fp", "copy", "spans", "block", "score", "n", "cdf", "u", "key", "words", "toxic", "rank"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(4, 1, 0), (5, 1, 0), (5, 1, 1), (6, 0, 1), (7, 1, 0), (9, 0, 0), (None, 1, 1), (8, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
