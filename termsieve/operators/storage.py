"""Tables in the folder that driver and executors share (`spark.checkpoint.dir`)."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A local session that names none gets a temporary one; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="termsieve-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/termsieve-{what}-{os.urandom(8).hex()}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """The table, written: its lineage ends there, and Spark knows its size."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; of one that is not there, none."""
    at, fs = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    at, fs = _at(spark, path)
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} could not be moved to {to}")


def upsert(fresh: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Rows replace those of their key in a table stored in hash buckets, and are added where there are none.

    Only buckets that fresh rows fall into are read, written anew and swapped when the job commits; the files of the others
    stay as they are. fresh: each key once; the first call makes the table.
    """
    spark, bucket = fresh.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = fresh.withColumn("bucket", bucket)
    if children(spark, path):
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # `buckets` numbers at most
        if not touched:
            return
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched))
        rows = old.join(fresh.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)
    # A bucket is written by the task that its rows are dealt to: one file.
    rows.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)


def upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")
