"""Tables on disk and the shared folder that holds intermediate results."""

import uuid

from . import packing

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark):
    """Folder for intermediate tables, as the cluster names it.

    A session without the setting (a test) keeps them beside its warehouse, which the executors
    share as well. No machine's own temporary folder is used.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stages"
    return folder.rstrip("/")


def staged_path(spark, name):
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_stages(spark):
    """Delete the staged tables of this application; call it when its results are written."""
    application = spark.sparkContext.applicationId
    # an optional subpackage stages its tables in a folder of its own
    for place in (application, f"llm/{application}"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{place}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df, name):
    """Write ``df`` once as Parquet and continue from the written table.

    Later passes read the stored columns they need, and a lost executor costs a re-read
    and not a recomputation of everything before.
    """
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark, path, schema=None):
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_profiles(df, path, digits=None):
    """Profiles partitioned by method, so that a report on one method reads only its files.

    Rows of a patient are in time order: integers and decimals are stored as what they change by. With ``digits``, the number of
    digits of the columns it names, rows are stored in packed chunks, which ``read_profiles`` opens.
    """
    options = {"parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}
    if digits is not None:
        df = packing.packed(df, "method", digits)
        options = {"parquet.enable.dictionary": "false", "compression": "uncompressed"}  # chunks are compressed already
    df.write.mode("overwrite").options(**options).partitionBy("method").parquet(path)


def read_profiles(spark, path, schema, digits, columns, methods=None):
    """The named columns of profiles that were written with ``digits``; with ``methods`` only the files of those."""
    return packing.read(spark, path, "method", schema, digits, columns, methods).select(*columns)
