import pytest

TEXTS = [
    None, "", "   \n\t ", "word", "one two three four", "ONE two three four five six seven", "one two three four five six seven",
        "one two three four five six seven eight",
    "one two three four five six seven", "é ü 中文 🙂 <s>[INST] x [/INST]</s> \\", "a\nb\na\n\nb\n", "x " * 3000,
]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls in every column, empty, short, long and repeated texts, and columns whose names clash."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "h", i, i * 2, "s") for i, t in enumerate(TEXTS)]
    rows += [(None, "one two three four five six seven", None, None, None, None, None), rows[6]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, spans string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
