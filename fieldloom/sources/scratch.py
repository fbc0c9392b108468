"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, a folder of the warehouse, or of a single machine's own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/_fieldloom"
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="fieldloom-"))
    return _own[0]


def materialized(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet and read back.

    It ends a plan's lineage (an executor lost later costs a re-read) and keeps optimiser rules from copying long
    expressions through a loop's steps. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/step-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)

    def clear() -> None:
        with contextlib.suppress(Exception):  # the session may be gone at exit
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(clear)
    return spark.read.schema(df.schema).parquet(path)
