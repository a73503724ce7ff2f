import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with extra columns whose names clash with those the operators use inside."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, at string, key string, rate string, kept string, p string, id string, row string, copies string"
        extra = ("x",) * 9
        full = [(i, t, "en", "s", len(t or ""), *extra) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, a very long text, ties, repeated rows, a null id."""
    words = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    plain = "The quick brown fox jumps over the lazy dog near the river bank today."
    return [
        (1, plain), (1, plain), (2, None), (3, ""), (4, " \n\t\x0b "), (5, words), (6, plain + " Extra."), (None, plain), (7, "é ß İ ﬁ <|endoftext|> it's"),
        (8, "one"), (9, "one two"), (-3, plain),
    ]
