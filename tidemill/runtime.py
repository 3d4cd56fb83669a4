"""Making the package importable where Python functions run, and tables in the folder that a cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once for an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tidemill-")
        path = os.path.join(folder, "tidemill_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"{top.name}/{p.relative_to(top)}")
        spark.sparkContext.addPyFile(path)
        if spark.conf.get(_BATCH) == "10000":  # the default; batches of long texts would take much memory beside the heap
            spark.conf.set(_BATCH, "1000")
        _shipped.add(app)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder of the session; where none is set and all runs in one process, in one of our own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidemill-shared-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession):
    """Shuffle files of the queries in here go when these end, not at some later collection of the driver's garbage.

    For writes: a DataFrame whose own exchanges are read again afterwards would compute them again.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back: what it holds is fixed, lineage ends there, and its exchanges are freed."""
    path = shared_folder(df.sparkSession, name)
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
