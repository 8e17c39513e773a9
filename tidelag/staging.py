"""Intermediate tables on storage that outlives executors."""

from __future__ import annotations

import contextlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of each session that queries are being cleaned up in: how many there are, and the setting before.
_cleaning: dict[int, tuple[int, str | None]] = {}
_lock = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, else its warehouse folder: both are shared by
    the driver and all executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Queries begun in here drop their shuffle files as soon as they end. The setting is one of
    the session, so it holds for all its queries meanwhile; threads that use it at the same time
    are counted, and the last one restores what there was before."""
    key = id(spark._jsparkSession)
    with _lock:
        users, before = _cleaning.get(key, (0, spark.conf.get(CLEAN_SHUFFLES, None)))
        _cleaning[key] = users + 1, before
        spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            users, before = _cleaning.pop(key)
            if users > 1:
                _cleaning[key] = users - 1, before
            elif before is None:
                spark.conf.unset(CLEAN_SHUFFLES)
            else:
                spark.conf.set(CLEAN_SHUFFLES, before)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Staging keeps a raw scan to one pass, survives lost executors, and tells the optimizer
    the true size. The shuffle files behind the table go when it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    with shuffles_cleaned(spark):
        df.select("*").write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def unstage(*staged: DataFrame) -> None:
    """Remove tables that ``stage`` wrote, once nothing reads them any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
