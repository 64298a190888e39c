"""Cut a plan at a written table, so several passes read columns instead of repeating a shuffle."""

from __future__ import annotations

import gc
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that outlive one plan, readable by the driver and every executor.

    The session's ``spark.checkpoint.dir``. Where it is unset, a folder in the warehouse serves, if the session is local or the
    warehouse lies in a store; a cluster with neither is told to name a folder, since executors do not share local disks.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return folder or _warehouse_dir(spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)


def _warehouse_dir(warehouse: str, master: str) -> str:
    local = master == "local" or master.startswith("local[")
    if not local and urlparse(warehouse).scheme in ("", "file"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse.rstrip('/')}/_cuts"


def session_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark).rstrip('/')}/flowloom-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. ``clear`` removes what a session has written.

    Spark deletes shuffle files once the driver has collected the plans they belong to. With ``release`` the driver is
    asked to collect now, which pays after a plan that has sent much. It is asked twice, since listeners hold a plan for a
    moment after its end.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if release:
        del df
        for _ in range(2):
            time.sleep(0.5)
            gc.collect()
            spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every table this application has written; frames that read them can no longer be run."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
