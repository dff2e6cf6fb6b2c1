"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ragtide") -> SparkSession:
    """Session for tests and the local bench. On a cluster, build your own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (tests, benches) gets a folder of its own;
    on a cluster a machine-local folder would lose data, so the setting is required there.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        cur = tempfile.mkdtemp(prefix="ragtide-ckpt-", dir=os.environ.get("RAGTIDE_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", cur)
    return cur


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ragtide`` importable in the Python workers, as ``--py-files`` does.

    The package's ``.py`` files are zipped once per application on the driver
    and handed to Spark, which distributes the zip to every executor; UDFs
    defined in the package can then be unpickled whatever the workers' path.
    """
    import zipfile

    import ragtide

    try:
        key = spark.sparkContext.applicationId
    except Exception:  # Spark Connect
        key = str(id(spark))
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(ragtide.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="ragtide-pyfiles-"), "ragtide.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, dirnames, files in os.walk(root):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    try:
        spark.sparkContext.addPyFile(out)
    except Exception:  # Spark Connect
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(key)
