"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share.

    Only a local session without one, as in tests, gets a temporary folder;
    on a cluster executors couldn't read it, so a missing setting raises.
    """
    context = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return found
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="fathom-"))
    return context.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """df written once and read again: a loop's plan stays short and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return together([path], df)


def together(paths: list[str], like: DataFrame) -> DataFrame:
    """Tables of one schema read as one."""
    out = like.sparkSession.read.schema(like.schema).parquet(*paths)
    out._paths = paths
    return out


#: Rows of a stored table that a task takes together where it sorts, hashes and counts them.
ROWS_A_TASK = 500_000


def tasks_for(rows: DataFrame) -> int:
    """Partitions that rows are dealt to so that each gets about ROWS_A_TASK at most, however many there are.

    Adaptive execution goes by compressed bytes, which says little of the
    memory that rows of short, alike keys take; so the rows are counted.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))


#: Rows of short keys, at most, that are sent to all tasks.
ROWS_TO_SEND = 2_000_000


def sent(rows: DataFrame, size: int) -> DataFrame:
    """rows, if their number (size) allows it to be sent to what they are joined with, which then isn't shuffled.

    Spark by itself goes by the compressed bytes of the whole stored table.
    """
    return F.broadcast(rows) if size <= ROWS_TO_SEND else rows
