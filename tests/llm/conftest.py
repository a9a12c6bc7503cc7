import os

import pytest

FOLDER = os.environ.get("CILENS_TEST_DATA", "/root/testdata/sf0.001")
#: Nulls, empty and blank texts, repeated rows, one id with several texts.
ODD = [(None, None), (None, "no id"), (1, None), (2, ""), (3, "  \n\t"), (4, "same words here again and again"), (4, "same words here again and again"),
       (4, "one id, another text"), (5, "é日本語 𝄞 a\tb\r\nc")]


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("test data not present")
    return FOLDER


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names the operators use inside."""
    rows = [(i, t, "x", 1, 2, "y", 0.5, "z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id int, text string, t string, h int, fp int, bucket string, score double, base string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
