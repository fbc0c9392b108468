"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of the warehouse, or of a single machine's (tests) own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        at = f"{spark.conf.get('spark.sql.warehouse.dir')}/_fieldloom"
    if not at:
        at = _local.setdefault("dir", "") or tempfile.mkdtemp(prefix="fieldloom-")
        _local["dir"] = at
    return at.rstrip("/")


class Scratch:
    """Named Parquet tables under one folder of the shared directory.

    ``keep`` writes a plan and reads it back, which cuts its lineage: an executor lost later costs a
    re-read, not a recomputation. ``drop`` frees a table that no later plan reads. What is left goes when
    the driver ends, as the returned DataFrames are lazy.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_by(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """``keep`` with rows of equal key in one of as many buckets as a shuffle has partitions: grouping them by key needs no shuffle."""
        table = f"fieldloom_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("compression", "zstd").option("path", self.path(name)).bucketBy(n, key).saveAsTable(table)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # the name alone: the files are this folder's, and the frame has found them
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        for n in names:
            self._delete(self.path(n))

    def clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone at exit
            self._delete(self.root)
