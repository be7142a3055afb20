"""Where this subpackage keeps tables that cut the lineage of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one in the warehouse, or on a local master one for this process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            folder = "file://" + tempfile.mkdtemp(prefix="streamloom-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/streamloom-tables"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """The frame as a Parquet table in the shared folder: read again, it depends on no executor."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def settle(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffles of jobs that are over: it does so once the driver's garbage is collected."""
    spark._jvm.System.gc()


def release(*frames: DataFrame) -> None:
    """Deletes the tables of frames from ``stored`` that nothing reads any more."""
    for df in frames:
        drop(df.sparkSession, df.__dict__["_table"])


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder through Spark's own file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
