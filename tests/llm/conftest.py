"""Documents with nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""

import pytest
from llm_helpers import prose

@pytest.fixture(scope="session")
def odd_docs(spark):
    long = prose(9, 60_000)
    rows = [
        (1, prose(1, 80)), (2, prose(1, 80)), (3, prose(1, 79) + " end"), (4, prose(4, 50)), (4, prose(4, 50)),
        (5, None), (6, ""), (7, " \n\t "), (None, prose(7, 40)), (None, None), (8, long), (9, long + " tail"), (10, "One"), (11, "12 34 !!"),
    ]
    return spark.createDataFrame(
        [(d, t, "x", i, t) for i, (d, t) in enumerate(rows)], "doc_id long, text string, id string, fp int, component string"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
