import tempfile

import pytest


@pytest.fixture(scope="module")
def shared(spark):
    """A shared folder for operators that store intermediate tables."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="insight-llm-"))
    return spark


@pytest.fixture
def documents(shared):
    """Rows with nulls, empty and long texts, ties, repeated rows and an extra column that clashes."""
    rows = [(1, "The cat sat on the mat"), (2, "The cat sat on the mat"), (3, ""), (4, None), (5, "word"), (6, "a b " * 3000),
            (7, "Été déjà-vu ## $$\n\nÉté déjà-vu ## $$\n x"), (8, "  \t\n "), (8, "  \t\n "), (None, "null id here"),
            (9, "one two three four five six seven eight nine ten eleven twelve")]
    return shared.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long, key string")
