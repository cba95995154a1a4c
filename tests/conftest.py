import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    top = tempfile.mkdtemp(prefix="weftline-test-")
    session = (
        SparkSession.builder.master("local[4]").appName("weftline-tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{top}/shared").config("spark.sql.warehouse.dir", f"{top}/warehouse").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(f"file://{top}/shared/checkpoints")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """First value of an expression over one literal row."""
    from pyspark.sql import functions as F

    return lambda col, **lits: spark.range(1).select(*[F.lit(v).alias(k) for k, v in (lits or {"_": 0}).items()]).select(col.alias("x")).first()["x"]
