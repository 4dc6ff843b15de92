"""Tables written where every executor can see them."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a query go when it ends, not at the driver's next garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_starting = threading.Lock()
#: This process's folder in each shared folder.
_homes: dict[str, str] = {}
#: The folder of the call that is under way in this thread, if there is one.
_call: ContextVar[str | None] = ContextVar("call", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    with _starting:
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not found:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="tabulon-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _path_of(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _home(spark: SparkSession) -> str:
    """A folder of this process in the shared one, deleted at the end of its JVM at the latest."""
    shared = shared_dir(spark)
    key = f"{spark.sparkContext.applicationId} {shared}"
    with _starting:
        if key not in _homes:
            _homes[key] = f"{shared}/tabulon/{uuid.uuid4().hex}"
            where, fs = _path_of(spark, _homes[key])
            fs.mkdirs(where)
            fs.deleteOnExit(where)
    return _homes[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other call uses: in the folder of the call under way, or in that of this process."""
    return f"{_call.get() or _home(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def call_folder(spark: SparkSession, name: str):
    """Tables made inside, by this thread or in a copy of its context, lie in one folder, which goes at the end, after errors too."""
    path = new_path(spark, f"{name}-call")
    token = _call.set(path)
    try:
        yield path
    finally:
        _call.reset(token)
        drop_path(spark, path)


def release(spark: SparkSession) -> None:
    """Deletes every table that this process has put in the shared folder; results that read them can't be used after."""
    drop_path(spark, _home(spark))


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cuts the lineage: df written as a table in the shared folder and read back."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    if spark.conf.get(CLEANUP, None) != "true":
        spark.conf.set(CLEANUP, "true")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame], path: str | None = None) -> DataFrame:
    """make()'s rows as one table in the shared folder; the tables that it made on the way are deleted, after errors too."""
    path = path or new_path(spark, name)
    try:
        with call_folder(spark, name):
            return stored(make(), name, path)
    except BaseException:
        drop_path(spark, path)
        raise


def drop_path(spark: SparkSession, path: str) -> None:
    where, fs = _path_of(spark, path)
    fs.delete(where, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete tables in a folder; none if there is no such folder."""
    where, fs = _path_of(spark, path)
    if not fs.exists(where):
        return []
    found = [x.getPath() for x in fs.listStatus(where)]
    return sorted(p.getName() for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
