import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def hot(spark):
    """Treat every group above 20 rows as too large for a task."""
    spark.conf.set("spark.heldout.hotRows", "20")
    yield
    spark.conf.unset("spark.heldout.hotRows")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
