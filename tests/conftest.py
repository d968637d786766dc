import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """A function that makes a two-column table (id, text)."""

    def make(*values):
        return spark.createDataFrame(list(enumerate(values)), "id int, text string")

    return make


def collect(df):
    return sorted(tuple(r) for r in df.collect())


AWS = "AKIA" + "ABCDEFGH12345678"
GHP = "ghp_" + "0123456789abcdef0123456789abcdef0123"
GENERIC = "api_key=" + "0123456789abcdef01234567"
