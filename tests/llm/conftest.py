import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text); the other columns hold nulls and clashing names are added."""
        frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
        return frame.selectExpr("*", "1 AS key", "'x' AS root", "2 AS n", "3 AS size", "4 AS run")

    return make
