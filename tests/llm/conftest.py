import pytest

WORDS = "the of moon river stone idiot lamp Ünder naïve 日本 x9 -- a\tb".split(" ")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and repeated rows, runs of spaces, a very long text, and a column whose name clashes."""
    texts = [None, "", " ", "  two  spaces ", "one\ntwo\r\n three", "tab\tand <|endoftext|> b", " lead", "trail ", "é́ \U0001f600 日本語", "a" * 3000, "word " * 4000, " ".join(WORDS * 30), " ".join(WORDS * 30), "don't we'll it's", "1 22 333 a1b2", "x　y z"]
    rows = [(k, t, "en", "s", k) for k, t in enumerate(texts)]
    rows.append((3, texts[3], "en", "s", 99))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, start long")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
