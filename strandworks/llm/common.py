"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and all runs on this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="strandworks-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage, survives the loss of any executor, and gives the
    planner the real size of the table, so that Spark itself decides by that
    size whether to broadcast it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, and bytes of rows, that a Python worker gets at once; texts can be long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded to BATCH_ROWS and BATCH_BYTES, so that two workers fit beside an executor's heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def as_text(number: str) -> Column:
    """A column of whole numbers as strings: pandas would turn those beside nulls into inexact floats."""
    return F.col(number).cast("string").alias(number)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
