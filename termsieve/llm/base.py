"""Shared pieces of the training-data operators: inputs, row keys, the shared folder."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch, where the session does not say. Workers hold a batch and what they make of it.
BATCH_BYTES = "4m"


def bounded(df: DataFrame) -> DataFrame:
    """The same table, in a session whose Arrow batches are bounded in bytes and not only in rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "1b") == "1b":  # not set
        conf.set(key, BATCH_BYTES)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row; a null text is empty. Other columns are ignored."""
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set there is one only if the driver is
    the executor (tests); a cluster must name one, since its machines do not see each other's folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="termsieve-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: With this set, a query's shuffle files go when it has ended, not when the driver happens to collect its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tidy(spark: SparkSession) -> SparkSession:
    """A session of the same settings whose queries remove their shuffle files when they have ended.
    For what is written; the given session stays as it is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(SWEEP, "true")
    return own


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Tables that are written in here leave no shuffle files. For frames of the given session, which `tidy` cannot take."""
    before = spark.conf.get(SWEEP)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Intermediate folders of this process that are still there, in the order they were made.
_made: list[str] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    _made.append(f"{shared_dir(spark)}/termsieve-{what}-{os.urandom(8).hex()}")
    return _made[-1]


def made() -> int:
    """A mark for `clear`: how many intermediate folders there are now."""
    return len(_made)


def clear(spark: SparkSession, since: int, keep: str) -> None:
    """Deletes the intermediate folders made after the mark, but one: when a job's results are written."""
    for path in [p for p in _made[since:] if p != keep]:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate folder that nothing lazy reads any more."""
    if path in _made:
        _made.remove(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Intermediate tables in the shared folder, which go together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        """The table, written; Spark knows its size from there on."""
        path = fresh_path(self.spark, what)
        with swept(self.spark):
            df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *what: str) -> None:
        """Deletes all of them, or those of the names given."""
        for path in [p for p in self.paths if not what or re.search(r"/termsieve-(.*)-[0-9a-f]+$", p)[1] in what]:
            self.paths.remove(path)
            remove(self.spark, path)


#: Bytes of a filter of ids, at most, and of the pieces that Spark makes it of.
FILTER_BYTES, PIECE = 1 << 23, 1 << 12


class IdFilter:
    """Bits, about 16 an id up to FILTER_BYTES, that say which ids may be among those of a table (column id): all
    that are, and some others. Small whatever the table, so rows need no shuffle to leave most others out."""

    def __init__(self, ids: DataFrame):
        with swept(ids.sparkSession):
            self._read(ids)

    def _read(self, ids: DataFrame) -> None:
        self.size = min(FILTER_BYTES, max(PIECE, 1 << (2 * ids.count()).bit_length()))
        place = ids.select((self.place() + 1).alias("place"))
        pieces = place.groupBy(F.bitmap_bucket_number("place").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        self.bits = np.zeros(self.size, np.uint8)
        for r in pieces.collect():  # FILTER_BYTES / PIECE rows at most
            self.bits[(r["k"] - 1) * PIECE : r["k"] * PIECE] = np.frombuffer(r["bits"], np.uint8)

    def place(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(8 * self.size))

    def has(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
