"""Session factory used by tests and the bench."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "quarrylight", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with AQE on, UTC timestamps and no UI."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return share_package(spark)


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share. Where
    it is unset, a local session gets a private folder, removed at exit; any other
    raises, as its executors could not read one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quarrylight-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        found = f"file://{_own[0]}"
    return found.rstrip("/")


_made: list[str] = []


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, for what a result reads lazily; it stays until
    ``release_scratch``."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Drop all scratch folders of this process, once their results have been written;
    returns how many."""
    n = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def share_package(spark: SparkSession) -> SparkSession:
    """Let Python workers of this session import the package from where the
    driver has it, whatever the working folder; for local and shared paths. Ship
    the package with ``--py-files`` elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark
