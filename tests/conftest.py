import os
import shutil
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    where = tempfile.mkdtemp(prefix="korral-test-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.warehouse.dir", os.path.join(where, "warehouse"))
        .config("spark.checkpoint.dir", os.path.join(where, "checkpoints"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
    shutil.rmtree(where, ignore_errors=True)


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("KORRAL_TEST_SF", "/root/testdata/sf0.001")
