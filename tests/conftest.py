from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import SparkSession

from tunegrain.runtime import build_session


def make_session() -> SparkSession:
    spark = build_session(
        "tunegrain-tests",
        master="local[8]",
        **{
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tunegrain-tests-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
