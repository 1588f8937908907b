"""Scratch tables in the folder that the cluster shares, and orders over whole tables.

Lineage is cut by written tables, which outlive executors. What is written goes
when the application ends, or sooner through ``free``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in this application's folder below the one that the cluster names in spark.checkpoint.dir.

    Where that is unset a local folder is chosen, but only if driver and executors are one process:
    elsewhere executors would write to their own disks. The application's folder goes when it ends.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif re.match(r"local(\[|$)", context.master):
            base = tempfile.mkdtemp(prefix="loomshed-")
            context.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    top = f"{base.rstrip('/')}/loomshed/{context.applicationId}"
    if getattr(context, "_loomshed_scratch", None) != top:
        file_system(spark, top).deleteOnExit(hadoop_path(spark, top))
        context._loomshed_scratch = top
    return f"{top}/{what}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, wherever it is."""
    return hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder."""
    file_system(spark, path).delete(hadoop_path(spark, path), True)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (dots as ``__``) for the time of a block."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_dropped(spark: SparkSession):
    """In this block, what an execution has shuffled is removed from the executors' disks when it ends."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written to the shared folder and read again: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def free(*frames: DataFrame) -> None:
    """Remove what ``stored`` wrote of frames that no later step reads."""
    for df in frames:
        drop_path(df.sparkSession, df._scratch_path)


#: Bits of a row's number inside its partition in monotonically_increasing_id.
_LOCAL = 33


def placed(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Adds ``block`` and ``place``: the range of the order that a row is in, and its 0-based place in the whole order.

    Rows are sorted in ranges, which are written, and a range's first place is the
    sum of the counts before it: one number a range, as many as there are shuffle
    partitions. No task holds more than a range, ties are split like other rows.
    """
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    held = stored(ranged.withColumn("_id", F.monotonically_increasing_id()), "placed")
    held = held.withColumns(
        {"block": F.shiftrightunsigned("_id", _LOCAL).cast("int"), "_local": F.col("_id").bitwiseAND(F.lit((1 << _LOCAL) - 1))}
    )
    counts = held.groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("block")) - F.col("_n")
    first = counts.select("block", ahead.alias("_ahead"))
    return held.join(F.broadcast(first), "block").withColumn("place", F.col("_ahead") + F.col("_local")).drop(
        "_id", "_local", "_ahead"
    )


def many(rows: DataFrame) -> DataFrame:
    """Rows of a table of any size, joined by a shuffle and a sort wherever they or what is made of them meet another.

    Spark would broadcast a table whose files are small, and compressed names and digests take ten times as
    much in the driver's memory. A union or a join upon the rows forgets this.
    """
    return rows.hint("merge")


def spread(rows: DataFrame, by: str, most: int = 20_000) -> DataFrame:
    """Narrow rows dealt out by a key before costly work: about ``most`` a task, however few splits their file has, and some for every core."""
    n = rows.count()
    return rows.repartition(max(1, -(-n // most), min(n, rows.sparkSession.sparkContext.defaultParallelism)), by)


def few(rows: DataFrame, column: str, most: int) -> list:
    """Distinct values of a column that are few by nature; raises beyond ``most``."""
    found = [r[0] for r in rows.select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"over {most} values of {column}")
    return sorted(found)
