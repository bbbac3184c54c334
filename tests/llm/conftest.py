import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns with names that results and intermediate steps use.
CLASH = "n bigint, cls string, kept string, score string, media string, th string, words string, key string, place string, spans string"


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of document tables: texts, or (id, text) pairs; optionally with clashing columns."""

    def make(texts, clash=False):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        kind = f"{DOC}, {CLASH}" if clash else DOC
        rest = (None,) * (kind.count(",") - 1)
        return spark.createDataFrame([(*r, *rest) for r in rows], kind)

    return make


@pytest.fixture(scope="session")
def edges(documents):
    """Null and empty texts, blanks, a null id, repeated rows, a very long text, extra columns."""
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000))
    return documents([(1, None), (2, ""), (3, " \n\t "), (None, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"), (6, long), (7, "Ünïcödé ΣΑΣ İ 漢字 🤗"), (7, "other text with the same id as another row")], clash=True)


@pytest.fixture(scope="session")
def none(documents):
    return documents([], clash=True)
