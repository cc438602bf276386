"""Shared helpers: table reading, the shared work folder, word counting."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: blank and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (tests, one machine) a folder of our own is made
    and set as the session's checkpoint folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tidefold-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver exits."""
    path = _qualified(spark, f"{shared_dir(spark)}/tidefold/{name}-{uuid.uuid4().hex}")
    atexit.register(remove_path, spark, path)
    return path


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its store's name, so that readers outside Spark take the same store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def remove_path(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage at a copy which survives the loss of any executor.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What this process has freed goes back to the system; Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of batches, after which its worker gives free memory back: workers outlive their tasks, and idle ones count beside the next stage's."""

    @functools.wraps(run)
    def held(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: str | Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    flat = F.btrim(or_empty(text), F.lit(SPACES))
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, "[ \\t-\\r]+"))).cast("bigint")


def columns_but(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` without those of these names (any case)."""
    gone = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]


def unused_prefix(df: DataFrame) -> str:
    """Underscores that no column's name begins with, for columns of an operator's own beside those of ``df``."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix
