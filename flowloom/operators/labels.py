"""Label normalisation and ground truth."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings of the web attacks and the class numbers of the labelled data set.
LABEL_FIXES = {
    "Web Attack Brute Force": "Web Attack – Brute Force",
    "Web Attack XSS": "Web Attack – XSS",
    "Web Attack Sql Injection": "Web Attack – Sql Injection",
    "Web Attack - Brute Force": "Web Attack – Brute Force",
    "Web Attack - XSS": "Web Attack – XSS",
    "Web Attack - Sql Injection": "Web Attack – Sql Injection",
}
CLASS_NUMBERS = {
    "BENIGN": 0,
    "FTP-Patator": 1,
    "SSH-Patator": 2,
    "DoS slowloris": 3,
    "DoS Slowhttptest": 4,
    "DoS Hulk": 5,
    "DoS GoldenEye": 6,
    "Heartbleed": 7,
    "Web Attack – Brute Force": 8,
    "Web Attack – XSS": 9,
    "Web Attack – Sql Injection": 10,
    "Infiltration": 11,
    "Bot": 12,
    "PortScan": 13,
    "DDoS": 14,
}
# What counts as benign when the truth is text, and where truth is looked for.
BENIGN_TOKENS = ("BENIGN", "NORMAL", "NORMAL.", "NORMAL TRAFFIC", "0", "0.0")
BINARY_TRUTH_COLUMNS = ("label_binary", "Label_Binary", "LABEL_BINARY")
TEXT_TRUTH_COLUMNS = ("Label", "label", "Class", "class")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _lookup(mapping: Mapping[str, object], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(table, key)


def normalise_label(label: str, fixes: Mapping[str, str] = LABEL_FIXES) -> Column:
    """Trim and unify spellings."""
    text = F.trim(F.col(label))
    return F.coalesce(_lookup(fixes, text), text)


def binary_label(label: str, benign: str = "BENIGN") -> Column:
    """0 for the benign label, 1 for anything else; the text ``default`` means attack by rule."""
    return F.when(F.col(label) == benign, 0).otherwise(1)


def class_number(label: str, numbers: Mapping[str, int] = CLASS_NUMBERS) -> Column:
    """Class number: exact name, else the first name that contains or is contained in the text.

    Texts that match nothing get the next free number. An empty text is contained in every
    name and so gets the first one.
    """
    text = F.lower(F.col(label))
    partial = None
    for name, number in numbers.items():
        hit = text.contains(name.lower()) | F.lit(name.lower()).contains(text)
        partial = F.when(hit, number) if partial is None else partial.when(hit, number)
    return F.coalesce(_lookup(numbers, F.col(label)), partial, F.lit(max(numbers.values()) + 1))


def class_table(spark: SparkSession, numbers: Mapping[str, int] = CLASS_NUMBERS) -> DataFrame:
    """The class names and numbers as a dimension table."""
    return spark.createDataFrame(list(numbers.items()), "label string, code int")


def with_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Normalised text label plus ``label_binary`` and ``label_multiclass``."""
    out = df.withColumn(label, normalise_label(label))
    return out.withColumn("label_binary", binary_label(label)).withColumn("label_multiclass", class_number(label))


def unknown_labels(labelled: DataFrame, label: str = "label", examples: int = 5) -> DataFrame:
    """Most frequent unknown texts with their rows, and the total under a null text."""
    unknown = max(CLASS_NUMBERS.values()) + 1
    per_text = labelled.where(F.col("label_multiclass") == unknown).groupBy(label).agg(
        F.count(F.lit(1)).alias("rows")
    )
    shown = per_text.orderBy(F.desc("rows"), label).limit(examples)
    total = per_text.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return shown.unionByName(total.withColumn(label, F.lit(None).cast("string")))


def day_of_file(name: Column) -> Column:
    """Weekday named in a file name, checked Monday first, else ``Unknown``."""
    text, out = F.lower(name), None
    for day in DAYS:
        hit = text.contains(day.lower())
        out = F.when(hit, day) if out is None else out.when(hit, day)
    return out.otherwise("Unknown")


def with_ground_truth(df: DataFrame, out: str = "y_true") -> tuple[DataFrame, str | None]:
    """Add 0/1 truth from a known label column; second value names the column, or ``None``.

    Text labels that are mostly numbers (over 90 %) are read as numbers; one aggregate decides.
    """
    for c in BINARY_TRUTH_COLUMNS:
        if c in df.columns:
            number = F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))
            return df.withColumn(out, (F.floor(number) > 0).cast("int")), c
    source = next((c for c in TEXT_TRUTH_COLUMNS if c in df.columns), None)
    if source is None:
        return df, None
    number = F.col(source).cast("string").try_cast("double")
    number = F.when(~F.isnan(number), number)
    share = df.agg(F.avg(number.isNotNull().cast("double")).alias("s")).first()["s"]
    if share is not None and share > 0.9:
        return df.withColumn(out, (F.coalesce(number, F.lit(0.0)) > 0).cast("int")), source
    token = F.upper(F.trim(F.coalesce(F.col(source).cast("string"), F.lit("nan"))))
    return df.withColumn(out, (~token.isin(*BENIGN_TOKENS)).cast("int")), source
