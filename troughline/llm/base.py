"""Shared helpers: staging, batch sizes, shipping the package to the workers."""

import ctypes
import gc
import os
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from troughline.sources.shipping import ship_package

#: Rows in one Arrow batch sent to Python. Texts are whole rows, so this bounds a worker's memory.
BATCH_ROWS = 1000


def shared_dir(spark):
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session without that setting (a test) gets a folder beside its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stages"
    return folder.rstrip("/")


def stage_path(spark, name):
    return f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df, name):
    """Write ``df`` to the shared folder and go on from the written table.

    A lost executor then costs a re-read, and every later pass sees the same rows.
    """
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables):
    """Delete staged tables that no later step reads, and the shuffles of finished steps.

    Spark deletes shuffles when the driver collects its garbage, which it otherwise does when its heap is full.
    """
    context = tables[0].sparkSession.sparkContext
    for table in tables:
        folder = context._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    context._jvm.System.gc()


def python_ready(spark):
    """Ship the package and bound the Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


_caches = []


def worker_cache():
    """A dictionary that a worker keeps from task to task, until ``release``."""
    _caches.append({})
    return _caches[-1]


def trim():
    """Give back the memory that Arrow and the C library hold and no object uses."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if give_back:
        give_back(0)


def release():
    """Give back what earlier steps left in this worker: their encoders, and unused memory."""
    for cache in _caches:
        cache.clear()
    trim()


def documents(df, id_col="doc_id", text_col="text"):
    """Id, text (null: empty) and ``th``, a hash of the text.

    A document is the pair of id and text: rows that repeat both are one document, rows that
    share an id but differ in text are different ones, and a null id is an id like any other.
    Other columns, whatever their names, are left out.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    return df.select(
        df[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text, F.octet_length(text)).alias("th")
    )


def bind(value, use):
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def read_file(path):
    with open(os.fspath(path), "rb") as handle:
        return handle.read()
