"""A local session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = "file://" + str(tmp_path_factory.mktemp("shared"))
    conf = {
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": shared + "/warehouse", "spark.driver.host": "127.0.0.1",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
