from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def profile(spark):
    """Rows ``(series, 'yyyy-MM-dd HH:mm', value)`` to a long profile with ``seq`` in list order."""

    def build(rows):
        listed = [(s, i, t, None if v is None else float(v)) for i, (s, t, v) in enumerate(rows)]
        df = spark.createDataFrame(listed, "series string, seq long, ts string, value double")
        return df.selectExpr("series", "seq", "cast(ts as timestamp_ntz) AS ts", "value")

    return build


@pytest.fixture
def units(spark):
    return lambda **named: spark.createDataFrame(list(named.items()), "series string, unit string")
