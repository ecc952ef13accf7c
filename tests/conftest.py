from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def build_session() -> SparkSession:
    from promolens.session import configure

    spark = (SparkSession.builder.master("local[8]").appName("promolens-tests")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g")
             .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="promolens-warehouse-"))
             .config("spark.sql.shuffle.partitions", "8")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@pytest.fixture(scope="session")
def spark():
    session = build_session()
    yield session
    session.stop()
