"""Tables and reports on shared storage. Every writer leaves a directory of part files."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators import score, split
from flowloom.operators.columns import flat_columns
from flowloom.operators.runs import with_alert_defaults

SPLITS = ("train", "val", "test")


def _read(spark: SparkSession, path: str, hint: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{path} not found; {hint}") from e
        raise


def write_bronze(df: DataFrame, path: str) -> str:
    """Raw rows as columnar files."""
    df.write.mode("overwrite").parquet(path)
    return path


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows; says which step is missing when there are none."""
    return _read(spark, path, "run the ingestion step first")


def write_json_rows(df: DataFrame, path: str, append: bool = False) -> str:
    """Rows as JSON lines."""
    df.write.mode("append" if append else "overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files of one JSON document each, pretty-printed or not; what follows the document in a file is not read."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, as ``write_json_rows`` leaves them; files are cut into many tasks."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def write_document(spark: SparkSession, document: Mapping, path: str) -> str:
    """One small JSON document (schema, mapping, metadata)."""
    text = json.dumps(document, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def read_document(spark: SparkSession, path: str) -> dict:
    """Read back one small JSON document."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def write_processed(
    df: DataFrame, schema: Mapping, mapping: Mapping, params: DataFrame | None, folder: str
) -> dict[str, str]:
    """Processed rows with their feature contract, label mapping and scaler parameters."""
    spark = df.sparkSession
    out = {"data": write_bronze(df, f"{folder}/processed_data")}
    out["schema"] = write_document(spark, schema, f"{folder}/feature_schema")
    out["labels"] = write_document(spark, mapping, f"{folder}/label_mapping")
    if params is not None:
        out["preprocessor"] = write_bronze(params.coalesce(1), f"{folder}/preprocessor")
    return out


def write_splits(df: DataFrame, path: str, settings: Mapping) -> dict[str, str]:
    """Rows partitioned by split plus a metadata table of sizes and label counts."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    write_json_rows(split.split_distributions(df).coalesce(1), f"{path}/split_metadata")
    write_document(df.sparkSession, settings, f"{path}/split_settings")
    return {"data": f"{path}/data", "metadata": f"{path}/split_metadata", "settings": f"{path}/split_settings"}


def read_splits(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The splits that exist; choosing one reads only its partition."""
    df = _read(spark, f"{path}/data", "create the splits first")
    have = {r["split"] for r in df.select("split").distinct().collect()}
    return {s: df.where(F.col("split") == s).drop("split") for s in SPLITS if s in have}


def write_csv_rows(df: DataFrame, path: str, append: bool = False) -> str:
    """Flat columns as CSV with a header."""
    flat_columns(df).write.mode("append" if append else "overwrite").csv(path, header=True)
    return path


def flow_sinks(flows_path: str, attacks_path: str, log_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: every flow to one sink, attacks to another, optionally a text log.

    Each batch lands in its own sub-folder, so a repeated batch replaces itself.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            score.flow_file_rows(batch).write.mode("overwrite").csv(f"{flows_path}/batch={batch_id}", header=True)
            score.attack_file_rows(batch).write.mode("overwrite").csv(f"{attacks_path}/batch={batch_id}", header=True)
            if log_path:
                score.attack_log_lines(batch).write.mode("overwrite").text(f"{log_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return save


def list_sessions(spark: SparkSession, pattern: str, limit: int = 20) -> DataFrame:
    """Newest sessions from their ``stats.json`` files; the folder name is the session id."""
    schema = "start_time string, runtime_seconds double, total_flows long, total_attacks long"
    df = read_json(spark, pattern, schema)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return (
        df.select(name.alias("id"), "start_time", F.bround("runtime_seconds").cast("long").alias("runtime"),
                  F.coalesce("total_flows", F.lit(0)).alias("flows"), F.coalesce("total_attacks", F.lit(0)).alias("attacks"))
        .orderBy(F.desc("id"))
        .limit(limit)
    )


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append alerts, partitioned by run, with defaults filled in."""
    with_alert_defaults(alerts).write.mode("append").partitionBy("run_id").parquet(path)


def delete_alerts(spark: SparkSession, path: str, run_ids: list[int], out: str) -> str:
    """Write the alerts that remain after deleting some runs; whole partitions are skipped."""
    _read(spark, path, "no alerts were written").where(~F.col("run_id").isin(run_ids)).write.mode("overwrite").partitionBy(
        "run_id").parquet(out)
    return out


def write_experiments(results: DataFrame, path: str) -> str:
    """Model results, best validation F1 first."""
    results.orderBy(F.desc("val_f1"), "name").coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def model_card(spark: SparkSession, results_path: str, importance_path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """A model's result row and its ten most important features."""
    results = spark.read.csv(results_path, header=True, inferSchema=True).where(F.col("name") == name)
    card = results.select("name", F.bround("test_f1", 4).alias("test_f1"), F.bround("test_roc_auc", 4).alias("test_auc"))
    ranked = spark.read.csv(importance_path, header=True, inferSchema=True)
    return card, ranked.orderBy(F.desc("importance"), "feature").limit(10)
