import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, token string, fp long"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards mix ten jugs of liquid with some very odd powder in a large bowl "


def odd_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows; columns whose names clash with the operators' own."""
    long = " ".join(f"w{i * 7919 % 5000}" for i in range(30_000))
    texts = [None, "", " ", "\n", "a", "a  b", "a b", "A\tB", "ünï cödé ☃", BASE, BASE + "x", BASE * 3, BASE * 3 + " y", long, long + " z", "<|endoftext|> x", " lead", "trail ", "a\x00b"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), "x", "y", 1) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (50, BASE, "en", "s1", 3, None, None, None), (None, "no id " + BASE, "de", "s2", None, None, None, None), (51, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
