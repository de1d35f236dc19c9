"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir; only where that is unset and the master is local (tests) a local folder is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="citegauge-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths written since the innermost `scratch` began; none outside of one.
_PATHS: ContextVar[list[str] | None] = ContextVar("paths", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What `written` leaves within goes at the end: for work whose results are out by then, such as a batch of a stream or a command."""
    paths: list[str] = []
    token = _PATHS.set(paths)
    try:
        yield
    finally:
        _PATHS.reset(token)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: found once, however often it is read. It stays there, but within `scratch`."""
    path = shared_path(df.sparkSession, name)
    if (paths := _PATHS.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
