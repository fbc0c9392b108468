"""A local session for development and tests; operators take any session as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cores: int | str = "*", memory: str = "4g", shuffle: int = 8) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName("fieldloom").config(map=conf).getOrCreate()
