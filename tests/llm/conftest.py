import pytest

#: Odd rows: null id, null text, empty and blank texts, repeats, one very long text, clashing extra columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, size int, mix string, component_id string, kept string"
LONG = "the quick brown fox jumps over the lazy dog again and again " * 4000


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), 7, "m", "c", "k")


ODD = [
    row(1, "One plain text of a few words.\nAnd a second line of it."), row(1, "One plain text of a few words.\nAnd a second line of it."),
    row(2, None, None, None), row(3, "", "en", "b"), row(4, " \t\n", "fr", "b"), row(5, "12 34 !!", "fr", None),
    row(None, "a text without an id", "en", "c"), row(6, LONG, "en", "c"), row(7, LONG + " end", "en", "c"),
    row(8, "été à la mer \U0001F600 naïve", "fr", "d"), row(1, "another text under the same id", "en", "a"),
    row(9, "<|endoftext|> two  spaces", "en", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
