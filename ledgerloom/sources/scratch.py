"""Tables of one job in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on one machine without that setting (tests) a temporary folder, on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ledgerloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_JOB: contextvars.ContextVar[str | None] = contextvars.ContextVar("job", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{_JOB.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def job(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables that are saved inside go when the job is over; its results must have been written elsewhere by then."""
    folder = new_folder(spark, name)
    token = _JOB.set(folder)
    try:
        yield
    finally:
        _JOB.reset(token)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows written once and read again: cuts the lineage, survives lost executors, and is computed once however often it is used."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
