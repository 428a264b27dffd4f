"""Session helpers shared by every module: table reading and the shared scratch folder."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (single-machine runs and tests).
LOCAL_SCRATCH = "/tmp/checkpoints"
#: Rows and bytes per Arrow batch sent to Python; texts may be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def local_session(cpus: int = 8, app: str = "tessera") -> SparkSession:
    """A session for one machine, with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by the cluster; without a name only a session on one machine has one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir isn't set")
    return folder or LOCAL_SCRATCH


#: The folder of the run that is going on, if it has one of its own.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What is stored within goes into one folder of the shared one, which is removed at the end: write results before."""
    folder = f"{shared_folder(spark).rstrip('/')}/tessera-{spark.sparkContext.applicationId}/run-{uuid.uuid4().hex[:12]}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    own = _RUN.get() or f"{shared_folder(spark).rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
    return f"{own}/{tag}-{uuid.uuid4().hex[:12]}"


def local_folder(spark: SparkSession, tag: str) -> str:
    """A new private folder of the shared one, for what reads and writes files by itself; the shared one must be a folder of files."""
    path = urlsplit(scratch_path(spark, tag))
    if path.scheme not in ("", "file"):
        raise RuntimeError("the shared folder isn't a folder of files")
    os.makedirs(os.path.dirname(path.path), exist_ok=True)
    os.mkdir(path.path, mode=0o700)
    return path.path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet in the shared folder and read it back.

    Later stages read files that outlive any executor, and nothing upstream runs twice.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
