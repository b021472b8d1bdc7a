"""Where jobs write tables between steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach, under ``spark.checkpoint.dir``. Where that is unset, a local session, as
    in tests, gets a folder of its own; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tables-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows written to a new shared folder and read from there: what follows doesn't repeat what made them, and a
    lost executor costs no more than the rows that it was reading."""
    path = shared_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task takes of a table that was dealt anew.
ROWS_A_TASK = 200_000


def spread(df: DataFrame, key: str, rows_a_task: int = ROWS_A_TASK, least: int = 1) -> DataFrame:
    """The rows dealt by ``key`` over tasks of about ``rows_a_task``. A file of a few narrow columns is one scan task however
    many rows it has, so what is costly for each row, or sorts them, would meet them all in one task. Few rows make
    fewer tasks than there are cores, of ``least`` rows each."""
    n = df.count()
    parts = max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-n // least)), -(-n // rows_a_task))
    return df.repartition(parts, key)
