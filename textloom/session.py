"""Session helpers shared by the queries, tests and benchmarks."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "textloom") -> SparkSession:
    """A local session with the settings the results depend on (UTC) and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """One of the Parquet tables; a file or a folder of parts.

    Where the session has Spark's own size of Arrow batches it gets a smaller one, as texts may be of any length.
    """
    ship(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")
    if spark.conf.get(_BYTES) == "67108864b":
        spark.conf.set(_BYTES, "16m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table for Python functions to work on: one that is read in fewer tasks than there are cores is dealt out. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; any other session has to set it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if context.applicationId not in _folders:
        _folders[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
    return _folders[context.applicationId]


_made: list[str] = []


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for what only this program reads; it is deleted when the program ends."""
    if not _made:
        atexit.register(_clear)
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _clear() -> None:
    session = SparkSession.getActiveSession()
    while _made:
        path = _made.pop()
        local = re.sub("^file:/*", "/", path)
        if os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
        elif session is not None:
            try:
                delete(session, path)
            except Exception:  # the session has ended before: the folder's owner has to clear it
                return


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that Python functions of its modules load there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="textloom-", suffix=".zip", delete=False) as out, zipfile.ZipFile(out, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(out.name)
    _shipped.add(app)
