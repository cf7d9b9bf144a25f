"""The folder that driver and executors share, for tables that are written once and read several times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of this machine where it is unset and Spark runs on this machine alone."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="threadlake-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; the JVM deletes it when it ends."""
    path = f"{folder(spark)}/threadlake/{label}-{uuid.uuid4().hex}"
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(hadoop).deleteOnExit(target)
    return path


@contextmanager
def set_for(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """Inside, the session has this setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver's garbage is collected."""
    return set_for(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def saved(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here, any executor may be lost, and its shuffle files go."""
    path = fresh_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
