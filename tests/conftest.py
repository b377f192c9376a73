import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    s = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    from lectern.runtime import ship

    ship(s)
    yield s


@pytest.fixture(scope="session")
def one(spark):
    """Value of a Column function for one text."""
    from pyspark.sql import functions as F

    def value(f, text):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]

    return value
