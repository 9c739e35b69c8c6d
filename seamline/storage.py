"""Tables written between two stages of a job.

A frame that several later passes read (a calibration grid, the carries of a
very long dialogue) is written once as Parquet in the folder that
``spark.checkpoint.dir`` names. Unlike a cache this survives lost executors,
and later passes read only the columns they need.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Rows go to Python workers in batches; a task holds one several times over.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Paths written by each application and not dropped yet.
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all executors share."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # Texts take two thirds of what the default makes of them, and tables stay until dropped.
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_in_batches(df: DataFrame, name: str, batch_bytes: int) -> DataFrame:
    """``store`` for rows with long texts or sets that go through Python workers: in batches
    of about ``batch_bytes``, whatever the number of rows that the session allows."""
    with _batches(df.sparkSession, batch_bytes):
        return store(df, name)


_LOCK = threading.Lock()
#: By session, how many calls hold its setting, and what it was before them.
_HELD: dict[int, tuple[int, str | None]] = {}


@contextmanager
def _batches(spark: SparkSession, batch_bytes: int) -> Iterator[None]:
    """The session's batches have ``batch_bytes`` at most, until the last of these calls ends."""
    session = spark._jsparkSession.hashCode()
    with _LOCK:
        now = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
        held, before = _HELD.get(session, (0, spark.conf.get(BATCH_BYTES) if BATCH_BYTES in spark.conf.getAll else None))
        _HELD[session] = held + 1, before
        if not 0 < now <= batch_bytes:
            spark.conf.set(BATCH_BYTES, str(batch_bytes))
    try:
        yield
    finally:
        with _LOCK:
            held, before = _HELD.pop(session)
            if held > 1:
                _HELD[session] = held - 1, before
            elif before is None:
                spark.conf.unset(BATCH_BYTES)
            else:
                spark.conf.set(BATCH_BYTES, before)


def drop_stored(spark: SparkSession) -> int:
    """Delete what this application has stored so far; how many tables that was.

    For long sessions, once the results made of these tables are written or read:
    a frame that still reads one fails afterwards.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    settings = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = hadoop(path)
        place.getFileSystem(settings).delete(place, True)
    return len(paths)
