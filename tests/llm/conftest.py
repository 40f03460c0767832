from __future__ import annotations

import pytest

from tests.llm import brute


@pytest.fixture(scope="session")
def messy(spark):
    """(rows, table) of documents with everything that can be wrong with them."""
    rows = brute.messy_documents()
    return rows, spark.createDataFrame(rows, brute.DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], brute.DOCS)
