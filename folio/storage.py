"""Tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: such a table
survives the loss of executors, and its files are compressed and columnar.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where that is unset (tests)."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not f"{spark.sparkContext.master}[".startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="folio-")
        shared_folder.own = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/folio/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str, **options: str) -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder; return the table read back, and its path."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    schema = df.schema
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path), path


def saved(df: DataFrame, tag: str, **options: str) -> DataFrame:
    return save(df, tag, **options)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of plans that are finished.

    It does so when the driver's JVM finds the plans unreachable, which may take long in an
    idle heap; called after an intermediate table is written, this bounds the disk to the
    largest step and not to the sum of all steps.
    """
    import gc

    gc.collect()
    spark._jvm.System.gc()


def release_memory(spark: SparkSession) -> None:
    """release_shuffles, and let executors collect, too.

    Relations of finished broadcasts, direct buffers and classes of finished plans stay with an executor
    until its heap is collected, which may take long while there is room; a job of many steps in one
    application calls this between them, so that each starts with the memory of live data."""
    release_shuffles(spark)
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
    asked = spark.range(0, 2 * executors, 1, 2 * executors).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")))
    asked.write.format("noop").mode("overwrite").save()
