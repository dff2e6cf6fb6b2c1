import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="ragtide-tests-")
    s = (
        SparkSession.builder.master("local[4]")
        .appName("ragtide-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from ragtide.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture
def scratch_dir():
    return tempfile.mkdtemp(prefix="ragtide-t-")


@pytest.fixture
def own_checkpoints(spark, scratch_dir, monkeypatch):
    """A folder of the test's own for intermediate tables, so that what is left in it is the test's."""
    from ragtide.operators import partitioning
    from ragtide.sources import store

    folder = os.path.join(scratch_dir, "checkpoints")
    for module in (partitioning, store):
        monkeypatch.setattr(module, "ensure_checkpoint_dir", lambda spark: folder)
    return folder
