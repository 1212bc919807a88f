"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the space and the control characters 9 to 13.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: Tasks that the rows of one hot key are dealt over in a join.
SALTS = 16


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset (tests) a new one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="wakeline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of the file, not a
    recomputation, and unlike a checkpoint the rows are kept columnar and
    compressed.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` that no later plan reads, and lets Spark drop the shuffle files of finished plans."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR_RUN, -1), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def has_word(text: Column) -> Column:
    """Whether anything but separators is in a text; not so for a null."""
    return F.coalesce(F.length(F.translate(text, SEPARATORS, "")) > 0, F.lit(False))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, even where ``body`` uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fence(df: DataFrame) -> DataFrame:
    """``df`` with a column ``_fence`` that is never negative.

    Being non-deterministic, it stops the optimizer from moving a filter that uses
    it below the projection, where every column the filter names would be computed
    anew for each mention.
    """
    return df.withColumn("_fence", F.monotonically_increasing_id())


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds what Spark hands to a Python worker at a time, so that long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Returns a worker's unused memory to the system; workers live on between stages and would keep it."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library
