"""Where jobs keep what they write: the folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one partition where a table is dealt by its keys: votes and their events are some hundred bytes.
ROWS = 200_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` into as many partitions as their number asks for, so that what a task sorts stays as much."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS))
    return rows.repartition(parts, *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that spark.checkpoint.dir names. A local-mode session that names none, as in tests,
    gets a temporary folder; any other master is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="palate-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(parts: list[DataFrame], name: str) -> DataFrame:
    """``parts`` of one table written to a new path, one after another, and read from there. The shuffle files that a part
    took go before the next; else they lie until the driver happens to collect its garbage."""
    spark, path = parts[0].sparkSession, scratch(parts[0].sparkSession, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        for part in parts:
            part.write.mode("append").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(parts[0].schema).parquet(path)
