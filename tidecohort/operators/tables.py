"""Intermediate tables: rows that several branches of a plan read must be the same rows in each."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; one machine alone may use a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidecohort-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written as Parquet to the shared folder and read back; a table that came from here is not written again."""
    if getattr(rows, "stored_at", None):
        return rows
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out.stored_at = path
    return out
