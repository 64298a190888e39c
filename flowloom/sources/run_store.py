"""Runs and their alerts as tables that can change: files are never edited, a version file says which ones count.

Rows lie in a fixed number of buckets of their run id. A change writes the buckets it touches anew, for both tables, and then
one small version file that names all current folders. Readers take the newest version file, so they see all of a change
or nothing of it, and a reader that has started keeps the files of its version until ``remove_unused``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
TABLES = ("runs", "alerts")
_BUCKET = "_bucket"


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path and a maker of its path objects."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, make = _hadoop(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(make(folder))] if fs.exists(make(folder)) else []


def _version(spark: SparkSession, store: str, number: int | None = None) -> tuple[int, dict]:
    """Number and content of the newest (or a given) version; 0 and no tables for a store that does not exist."""
    if number is None:
        number = max((int(n) for n in _names(spark, f"{store}/versions") if n.isdigit()), default=0)
    if not number:
        return 0, {}
    return number, json.loads("\n".join(r["value"] for r in spark.read.text(f"{store}/versions/{number}", wholetext=True).collect()))


def _commit(spark: SparkSession, store: str, number: int, content: dict) -> int:
    """Put a version file in place by one rename, which fails when another writer has taken the number."""
    fs, make = _hadoop(spark, store)
    draft, final = make(f"{store}/drafts/{uuid.uuid4().hex}"), make(f"{store}/versions/{number}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"another writer has made version {number} of {store}; read again and repeat the change")
    return number


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn(_BUCKET, F.pmod(F.xxhash64(F.col("run_id").cast("long")), F.lit(BUCKETS)).cast("int"))


def _write(df: DataFrame, store: str) -> dict[str, list[str]]:
    """New files of each bucket; Spark splits the bucket of a busy run over several writers."""
    name = uuid.uuid4().hex
    _bucketed(df).hint("rebalance", F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{store}/data/{name}")
    found = [n for n in _names(df.sparkSession, f"{store}/data/{name}") if n.startswith(f"{_BUCKET}=")]
    return {n.split("=")[1]: [f"data/{name}/{n}"] for n in found}


def _read(spark: SparkSession, store: str, table: dict | None, buckets: set[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(table["schema"])
    folders = [f"{store}/{d}" for b, dirs in sorted(table["folders"].items()) if buckets is None or b in buckets for d in dirs]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _merged_schema(old: dict | None, df: DataFrame) -> dict:
    fields = list(T.StructType.fromJson(old["schema"]).fields) if old else []
    have = {f.name: f.dataType for f in fields}
    for f in df.schema.fields:
        if f.name in have and have[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {have[f.name].simpleString()} in the store, {f.dataType.simpleString()} in the rows")
    return T.StructType([*fields, *[T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name not in have]]).jsonValue()


def _touched(ids: DataFrame) -> set[str]:
    """Buckets of some runs: at most ``BUCKETS`` names."""
    return {str(r[0]) for r in _bucketed(ids.select("run_id")).select(_BUCKET).distinct().collect()}


def read(spark: SparkSession, store: str, table: str, version: int | None = None) -> DataFrame:
    """Rows of ``runs`` or ``alerts`` as of the newest or a given version."""
    number, content = _version(spark, store, version)
    if table not in content:
        raise FileNotFoundError(f"{store} has no {table}" + (f" in version {number}" if number else "; nothing was written yet"))
    return _read(spark, store, content[table])


def append(store: str, table: str, rows: DataFrame) -> int:
    """Add rows in a new version, whose number is returned; columns that the table lacks are null in its older rows."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table}")
    spark = rows.sparkSession
    number, content = _version(spark, store)
    old = content.get(table)
    schema = _merged_schema(old, rows)
    folders = {b: list(d) for b, d in old["folders"].items()} if old else {}
    for b, dirs in _write(rows, store).items():
        folders.setdefault(b, []).extend(dirs)
    return _commit(spark, store, number + 1, content | {table: {"schema": schema, "folders": folders}})


def update_runs(store: str, changes: DataFrame) -> int:
    """Set the given fields of runs; a null leaves a field as it is and an unknown run is added.

    ``changes`` has one row a run. Only the buckets of these runs are read and written.
    """
    spark = changes.sparkSession
    number, content = _version(spark, store)
    if "runs" not in content:
        return append(store, "runs", changes)
    old, touched = content["runs"], _touched(changes)
    schema = _merged_schema(old, changes)
    before = _read(spark, store, {"schema": schema, "folders": old["folders"]}, touched).alias("b")
    both = before.join(changes.alias("c"), F.col("b.run_id").eqNullSafe(F.col("c.run_id")), "full_outer")
    names = [f["name"] for f in schema["fields"]]
    after = both.select(*[F.coalesce(f"c.`{n}`", f"b.`{n}`").alias(n) if n in changes.columns else F.col(f"b.`{n}`") for n in names])
    folders = {b: d for b, d in old["folders"].items() if b not in touched} | _write(after, store)
    return _commit(spark, store, number + 1, content | {"runs": {"schema": schema, "folders": folders}})


def delete_runs(store: str, ids: DataFrame) -> int:
    """Remove runs (``run_id``) together with their alerts, in one version; ids that the store lacks change nothing."""
    spark = ids.sparkSession
    number, content = _version(spark, store)
    touched, gone = _touched(ids), ids.select("run_id").distinct()
    after = {}
    for name, table in content.items():
        kept = _read(spark, store, table, touched).join(gone, "run_id", "left_anti").select(*[f["name"] for f in table["schema"]["fields"]])
        folders = {b: d for b, d in table["folders"].items() if b not in touched}
        after[name] = {"schema": table["schema"], "folders": folders | _write(kept, store)}
    return _commit(spark, store, number + 1, after)


def remove_unused(spark: SparkSession, store: str, keep: int = 1) -> int:
    """Delete the version files but the newest ``keep``, and data folders that none of these names; no writer may be at work."""
    numbers = sorted(int(n) for n in _names(spark, f"{store}/versions") if n.isdigit())
    used = set()
    for n in numbers[-max(keep, 1):]:
        used |= {d.split("/")[1] for t in _version(spark, store, n)[1].values() for dirs in t["folders"].values() for d in dirs}
    fs, make = _hadoop(spark, store)
    old = [f"versions/{n}" for n in numbers[: -max(keep, 1)]]
    doomed = old + [f"data/{n}" for n in _names(spark, f"{store}/data") if n not in used]
    for name in doomed:
        fs.delete(make(f"{store}/{name}"), True)
    return len(doomed)
