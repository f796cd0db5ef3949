import pytest
from llm_helpers import prose

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, class string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and blank texts, repeated rows, ties, near copies, a shared passage, a long text, clashing column names."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    shared = prose(2, 70)
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(3, 90) + "\n" + shared), (5, shared + " " + prose(4, 90)), (6, None), (7, ""),
        (8, " \t\n "), (9, "one two"), (10, "One  TWO"), (11, prose(5, 9000)), (12, "word " * 300), (12, "word " * 300), (None, prose(6, 80)), (13, "é ü ß " * 20),
    ]
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), "big", "c") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, None), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
