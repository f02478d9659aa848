import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def points(spark):
    """Rows with many exact copies, so crowded groups and ties occur."""
    import numpy as np

    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4)).round(2)
    x[20:40] = x[0]  # a third of all rows are copies of one
    x[41] = x[42]
    rows = [(int(i), [float(v) for v in r], int(i % 3) if i % 11 else -1) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, features array<double>, cluster int"), x
