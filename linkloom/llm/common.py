"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sent to a Python worker at once, at most.
BATCH_ROWS = 500
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of at most ``BATCH_ROWS`` rows.

    Spark's own bound of 10,000 rows lets a batch of whole texts grow to tens of MB, which
    the JVM and the worker then both hold.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (shared or f"{tempfile.gettempdir()}/linkloom-{uuid.uuid4().hex}").rstrip("/")


def give_back() -> None:
    """Return to the system what the driver's Python no longer uses; the allocators keep what training took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a copy in the shared checkpoint folder.

    Spark frees the shuffle files of plans that the driver has forgotten when the driver
    collects its garbage, so that is asked for here: a loop of checkpoints then holds the
    disk of a step or two.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint()
    give_back()
    spark._jvm.System.gc()
    return out


def fold(id_column: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_column).cast("string")) % 4


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """At most ``limit`` rows (text, y) for each class, taken in the order of a hash of the id.

    Rows whose fold is 2 are held out. The bound is a documented parameter of the
    classifiers; what is learned from them depends on these rows alone.
    """
    y = labels.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("_id").isNotNull() & (fold("_id") != 2))
    y = y.groupBy("_id").agg(F.min("y").alias("y"))
    order = F.xxhash64("_id")
    picked = [y.where(F.col("y") == c).orderBy(order, "_id").limit(limit) for c in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "_id").select("_id", "text", "y")
