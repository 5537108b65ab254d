import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def demo(spark):
    from lakemill.engine import Engine

    engine = Engine(spark)
    engine.demo()
    s = engine.spark
    engine.register("a", s.createDataFrame([(1, 10, 5, "x"), (2, 20, None, "y"), (3, None, 7, "z"), (4, 10, 1, "w"), (5, 30, 9, "x")], "id long, k long, v long, s string"))
    engine.register("b", s.createDataFrame([(7, 10, 2, "x"), (8, 30, 8, "y"), (9, None, 4, "z"), (10, 10, 6, "q")], "id long, k long, v long, s string"))
    return engine


SF = "/root/testdata/sf0.001"
