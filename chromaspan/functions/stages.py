"""Tables that several results read are written once, to the folder that the cluster shares."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Tables of up to so many bytes, by their number of rows, are broadcast.
BROADCAST_BYTES = 8 << 20
#: Bytes of rows, by their expected number, that one task of a wide step is to take.
TASK_BYTES = 128 << 20
#: Whether Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the session's shared folder; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back, so that it is computed once; its shuffle files, which nothing reads again, go when it is written."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written_and_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As ``written``, with the number of rows, which is counted as they are written."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return table, seen.get.get("rows", 0)


def numbered(df: DataFrame, key: str, name: str, label: str) -> DataFrame:
    """``df`` written in ranges of ``key``, which is unique, with ``name``: the place of a row in that order, from 0; only a count by range goes through the driver."""
    (part,) = fresh(df, "part_")
    ranged = df.repartitionByRange(key).sortWithinPartitions(key)
    table = written(ranged.withColumn(part, F.spark_partition_id()), label)
    before, total = [], 0
    for row in table.groupBy(part).count().orderBy(part).collect():
        before.append((row[part], total))
        total += row["count"]
    (own, start) = fresh(table, "own_", "before_")
    starts = F.broadcast(df.sparkSession.createDataFrame(before, f"{own} int, {start} long"))
    place = F.row_number().over(Window.partitionBy(part).orderBy(key)) - 1
    return table.withColumn(name, place.cast("long")).join(starts, F.col(part) == F.col(own)).select(*df.columns, (F.col(name) + F.col(start)).alias(name))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    tail = ""
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


def is_small(df: DataFrame, row_bytes: int = 100) -> bool:
    """Whether a count of its rows, which stops at the bound, allows a table to be broadcast."""
    most = BROADCAST_BYTES // row_bytes
    return df.limit(most + 1).count() <= most


def bounded(df: DataFrame, row_bytes: int = 100) -> DataFrame:
    """``df``, marked for broadcast if it is small; else joins with it are shuffle joins."""
    return F.broadcast(df) if is_small(df, row_bytes) else df


def written_small(df: DataFrame, label: str, row_bytes: int = 100) -> DataFrame:
    """``df``, a row for each chromosome or the like, written and marked for broadcast if its number of rows allows it."""
    table, rows = written_and_counted(df, label)
    return F.broadcast(table) if rows <= BROADCAST_BYTES // row_bytes else table


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df``, whose joins are sorted merges: Spark broadcasts by the size of files, which is no bound of the rows' bytes."""
    return df.hint("merge")


def parts_for(spark: SparkSession, total_bytes: float) -> int | None:
    """Partitions of a shuffle of so many bytes, so that a task's share does not grow with the input; None where the session's number is enough."""
    n = math.ceil(total_bytes / TASK_BYTES)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, parts: int | None, *keys: str | Column) -> DataFrame:
    """``df`` by hash of ``keys``, in ``parts`` partitions or the session's number."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)
