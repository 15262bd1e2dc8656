import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stratalog.session import build_session  # noqa: E402


def make_session():
    spark = build_session("tests", "local[8]", 8, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
