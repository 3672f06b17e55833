from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("logsift-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines_of(spark):
    """Lines of logs given as ``{source: text}``."""
    from logsift.sources.text_column import lines_from_text

    def build(**texts):
        rows = [(source, text) for source, text in texts.items()]
        return lines_from_text(spark.createDataFrame(rows, "source string, text string"))

    return build


@pytest.fixture(scope="session")
def apply(spark):
    """The values of a column function over a list of strings, in order."""
    from pyspark.sql import functions as F

    def run(function, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
        rows = df.select("i", function(F.col("s")).alias("v")).orderBy("i").collect()
        return [row.v for row in rows]

    return run
