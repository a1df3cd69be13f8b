import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, kept string, _hash string, component_id string, fp string, length string, start string, piece string"


@pytest.fixture(scope="session")
def docs(spark):
    """Build documents from (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""

    def build(pairs):
        rows = [(i, t, None, None, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x") for i, t in pairs]
        return spark.createDataFrame(rows, WIDE)

    return build


#: Nulls, empties, a very long text, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five"), (5, "one two three four five"), (5, "one two three four five"), (6, "word " * 30000), (None, "no id here at all"), (7, "Été à l'œuvre 日本 \x1c x"), (8, "a" * 5000)]


@pytest.fixture
def odd():
    return ODD
