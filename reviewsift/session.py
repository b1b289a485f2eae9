"""Session helpers: local sessions for tests, and shared-folder materialisation."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_fallback_dirs: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "reviewsift", memory: str = "8g") -> SparkSession:
    """A session for tests and local measurements; clusters bring their own."""
    parallelism = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on a local master."""
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"Set {_CHECKPOINT_KEY} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="reviewsift-")
        atexit.register(shutil.rmtree, _fallback_dirs[app], ignore_errors=True)
    return _fallback_dirs[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a parquet table in the shared folder and read it back.

    Cuts the lineage without relying on executor-local blocks, so a lost executor costs a
    re-read, and values that depend on partition placement are frozen in the table. Tables
    stand under the application's id, so that a finished application's can be removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reviewsift/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers, wherever they run (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(package)
    target = os.path.join(tempfile.mkdtemp(prefix="reviewsift-zip-"), name)
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, name))
    _shipped.add(app)
