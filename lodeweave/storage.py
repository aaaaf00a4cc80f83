"""Tables between stages, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # folder by application, where the session names none
_SCOPES: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, local masters get a folder of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = _LOCAL.get(context.applicationId)
        if at is None:
            at = _LOCAL[context.applicationId] = f"file:///tmp/lodeweave-{uuid.uuid4().hex}"
            atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted at the end of the scope, or else of the driver's JVM."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _file(spark, path)
    fs.deleteOnExit(p)
    if _SCOPES:
        _SCOPES[-1].append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end what was stored inside; results must be written or collected before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            fs, p = _file(spark, path)
            fs.delete(p, True)


def _file(spark: SparkSession, path: str):
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(context._jsc.hadoopConfiguration()), p
