"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def prepare_session(spark: SparkSession) -> SparkSession:
    """Pin the run-time settings every operator assumes; safe on a shared session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build_session(
    app_name: str = "flowloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """Create a session; on a cluster leave ``master`` unset and let the submit command decide.

    ``spark.sql.legacy.javaCharsets`` must be set before the first CSV scan because
    windows-1252 files are part of the raw data set.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
