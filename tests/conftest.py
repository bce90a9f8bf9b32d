from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import SparkSession

from orewell.session import ship


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-")
    build = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
    session = build.config("spark.local.dir", scratch).config("spark.checkpoint.dir", scratch).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()
