"""Tables that an operator writes once and reads several times."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_A_FILE = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, in local mode only, a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "barquill-checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to; ``forget`` deletes what is there."""
    return f"{shared_dir(spark)}/barquill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, never a recomputation of what came before. Unlike
    ``checkpoint()`` the table is columnar, so later steps read only the columns they need. If it is known to have at
    most about ``rows`` narrow rows, it gets a file for each half million rather than one for each shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete one table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(spark: SparkSession) -> None:
    """Delete every table and file that this application has put into the shared folder by ``materialize`` or ``new_path``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/barquill-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
