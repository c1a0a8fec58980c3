"""Where intermediate tables go, and how a plan's lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, on one machine, a new one that goes when Python ends."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="gleaner-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, rows: int, *keys: str, most: int) -> DataFrame:
    """df in tasks of about `most` rows: a small file can hold rows that grow large, and Spark cuts by bytes alone."""
    return df.repartition(max(1, -(-rows // most)), *keys)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: a lost executor costs no recomputation."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
