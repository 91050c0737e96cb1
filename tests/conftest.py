import os

import pytest

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from sheetwise.session import session

    s = session(
        "tests",
        master="local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.driver.host": "127.0.0.1"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
