"""Fixtures: a table of awkward documents, and an empty one."""
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, norm string, id long, kept boolean, row string, label int"


def awkward():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, extra columns."""
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word60 ", "other60 ")
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40000))
    texts = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two"), (8, "one two"), (9, "ONE  two"),
        (None, base), (None, "only here"), (10, long), (11, long + " end"), (12, "ünïcode ß 漢字 \U0001F600 text"), (13, "a\nb\na\n\nb\na"),
        (14, "<|endoftext|> in a text <|endoftext|>"), (15, "\x1c\x85\xa0  white space　kinds '’s 12½ ٠ x"), (16, "aaaa " * 300),
        (17, base + " tail"), (17, "same id, other text"),
    ]
    return [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"src{n % 3}", None, "n", 5, True, "r", 1) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
