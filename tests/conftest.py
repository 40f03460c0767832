from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import SparkSession

from recollect.plans.index import build_index
from recollect.schemas import ITEMS


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.codegen.wholeStage", "false")  # tiny data: compiling costs more than it saves
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# A small archive. The vectors have four numbers; likeness stands for what an
# image looks like: 0 handwriting, 1 a screen, 2 a diagram, 3 a face.
ARCHIVE = [
    (1, "phone", "OSI model notes: seven layers of computer networks. CN lecture", [1.0, 0.0, 0.1, 0.0]),
    (2, "phone", "OSI model diagram, computer networks CN chapter two", [0.8, 0.0, 0.9, 0.0]),
    (3, "laptop", "Python login error: invalid password. Traceback follows", [0.0, 1.0, 0.0, 0.0]),
    (4, "laptop", "Python plotting example without trouble", [0.0, 0.9, 0.2, 0.0]),
    (5, "chat", None, [0.0, 0.1, 0.0, 1.0]),
    (6, "phone", "Database notes: normalization and keys. Handwritten summary", [0.9, 0.0, 0.0, 0.0]),
    (7, "chat", "Restaurant receipt, trip to Bangalore. Please pay by 2024-05-17. Or on 2024-13-45", None),
    (8, None, "Shopping list: milk and bread", None),
]


@pytest.fixture(scope="session")
def archive(spark):
    rows = [
        (i, source, None, None, None, None if source is None else {"lang": "en"}, text, vec)
        for i, source, text, vec in ARCHIVE
    ]
    return spark.createDataFrame(rows, ITEMS)


@pytest.fixture(scope="session")
def index(spark, archive):
    return build_index(archive, dim=4, buckets=2)


@pytest.fixture
def start():
    return dt.date(2025, 1, 6)
