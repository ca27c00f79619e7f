"""Durable intermediate tables in the folder all executors share, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured size is below this.
BROADCAST_BYTES = 64 << 20

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset, a local one, and only under a local master."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = sc.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="sitequarry-")
        sc.setCheckpointDir(_local[app])
        _at_exit(spark, _local[app])
    return _local[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)

    atexit.register(remove)


class Workspace:
    """A folder of intermediate Parquet tables in the shared folder.

    A written table cuts the lineage: a lost executor costs no more than the tasks it was running. ``drop`` removes a table
    as soon as nothing reads it any more; what a returned DataFrame still reads is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _at_exit(spark, self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def partitioned(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """A table with a folder for each value of a string column, each written by one task, so that a filter on it reads no other."""
        path = f"{self.root}/{name}"
        df.repartition(column).write.mode("overwrite").partitionBy(column).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its ``rows`` (counted) fit the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
