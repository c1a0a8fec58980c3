"""Shared-storage helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset (tests on one machine) a new one that goes when Python ends.

    A cluster without that setting is an error: a folder of the driver's machine would not be seen by executors.
    """
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="gleaner-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes a table to the shared folder and reads it again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def discarded(df: DataFrame) -> None:
    """Deletes a table that written() gave, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def own_ids(docs: DataFrame) -> bool:
    """Whether doc_id is never null and another one in each row."""
    return docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()


def unique_rows(docs: DataFrame, whole: bool = False, own: bool | None = None) -> DataFrame:
    """key (long, never null, its own for each row, ordered as doc_id), doc_id, text and with `whole` all columns as struct `row`.

    Where doc_id tells all rows apart (own_ids(), asked here unless given) it is the key. Else rows are numbered in the
    order of doc_id (nulls last), text hash, and written, so that a number stays what it is; equal rows and a doc_id of
    many rows are split like others.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
    if own_ids(docs) if own is None else own:
        return rows.withColumn("key", F.col("doc_id"))
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id())
    return written(ordered.withColumn("key", F.monotonically_increasing_id()), "numbered-rows")


#: Keys that may be broadcast as frequent ones.
MOST_HOT = 1_000_000


def hot_keys(counts: DataFrame, on: list[str], least: int) -> DataFrame | None:
    """Keys `on` of counts (on, n) with n over `least`, or over more than that if they were more than MOST_HOT; None for none.

    Their number is checked, so the table may be broadcast.
    """
    counts = written(counts.where(F.col("n") > least), "hot-keys")
    found = counts.count()
    while found > MOST_HOT:
        least *= 4
        found = counts.where(F.col("n") > least).count()
    return counts.where(F.col("n") > least).select(*on) if found else None


#: Rows of one key that a join may bring to one task, unless that made more than 100,000 keys frequent.
FREQUENT = 10_000


def frequent(left: DataFrame, on: list[str], rows: int | None = None) -> DataFrame | None:
    """Keys `on` that more than FREQUENT rows of left have, with the buckets (_parts) to deal them to; None for none.

    At most 100,000 keys, as the bound grows with left (`rows`, counted unless given).
    """
    least = max(FREQUENT, (left.count() if rows is None else rows) // 100_000)
    if rows is not None and rows <= least:
        return None
    found = left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(*on, F.ceil(F.col("_n") / least).cast("int").alias("_parts"))
    found = written(found, "frequent-keys")
    return None if found.isEmpty() else found


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined to right; rows of left with a key of `hot` are dealt over its buckets by their hash, right's go to each."""
    if hot is None:
        return left.join(right, on, how)
    salted = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copies = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined to right on keys that any number of left rows may have; left is read more than once."""
    return dealt_join(left, right, on, frequent(left, on), how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
