import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark, tmp_path):
    """Write rows as a Parquet folder and return its path."""

    def write(name, rows, ddl):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(path)
        return path

    return write


def rows(df, *order):
    order = order or df.columns
    return [tuple(r) for r in df.orderBy(*order).collect()]
