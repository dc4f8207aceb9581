"""Session construction and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDER: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[str] = []


def build_session(app: str = "quillspark", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators expect; cluster settings may override any of them."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # text work is heavy per byte, so small shuffles are worth spreading
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call-site capture costs several driver round trips for every column built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the executors, once per application, wherever the driver imported it from."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="quillspark-package-"), "quillspark.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("quillspark", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a machine-local
    folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDER:
        _LOCAL_FOLDER[app] = tempfile.mkdtemp(prefix="quillspark-")
    return _LOCAL_FOLDER[app]


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def note_written(path: str) -> None:
    """Lists a folder that the innermost open ``scratch`` will delete."""
    _WRITTEN.append(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what jobs inside have written below the shared folder, results once they are used included."""
    start = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[start:]:
            delete_folder(spark, path)
        del _WRITTEN[start:]


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table of many partition folders, listed by a few tasks for each core.

    Spark's own bound of 10,000 tasks is a task for each folder of most tables, and a task costs more than
    listing a folder does.
    """
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.parquet(path)  # lists as it is built
    finally:
        spark.conf.set(LISTING, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back, which cuts its lineage.

    A written table is computed once and keeps column pruning for every later reader. It stays until
    the ``scratch`` around it ends, or the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quillspark/{uuid.uuid4().hex}"
    note_written(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
