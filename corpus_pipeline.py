"""From raw documents to packed training sequences: language, quality, near copies, repeated passages, packing.

Every stage takes the rows that its predecessor has kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.llm import language, near, packing, quality, substrings

#: A text whose best language has a smaller cosine is taken for none of the languages. Texts without a trigram of a
#: language have cosines of standard deviation 1 / sqrt(DIMENSIONS) = 0.0156 with it; 4.5 of these, 0.0703, are passed by
#: about 3 in a million a language. On sf0.01, clean texts of 6 characters and more had at least 0.083 with their own.
LEAST_COSINE = 4.5 / language.DIMENSIONS**0.5
#: A text is rejected when good quality is less likely than this.
LEAST_QUALITY = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts that Spark sends to a Python worker at a time. Stages run when their result is written, so the session keeps this.
TEXT_ROWS = 1024


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in one of the languages that the table names; ``lang`` becomes the language found.

    Null, empty and letterless texts go. Repeated rows share their fate; a tie of languages goes to the first by name. Rows
    without an id stay like others. Without a named language every text goes. Columns beyond those of ``documents`` are dropped.
    """
    _small_batches(spark)
    found = language.identify(docs.select(*COLUMNS), language.learn(docs))
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_COSINE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that the classifier, trained on the labelled ones among them, does not reject.

    Null and empty texts have the score of no features. Repeated rows share their fate. Labels of other or missing ids are not
    used; without any label every score is 0.5 and every text stays.
    """
    _small_batches(spark)
    weights = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), weights).filter(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest ``doc_id`` of every class of near copies.

    Texts without words, and rows without an id, are copies of nothing and stay. Of rows that share an id the smallest text stays.
    """
    _small_batches(spark)
    return near.one_of_each(docs.select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages that a smaller ``doc_id`` has; a text that loses every word goes.

    Texts of fewer than 13 words, nulls among them, and rows without an id stay as they are. A passage inside one document, or of rows
    with one id, is no repeat.
    """
    _small_batches(spark)
    found = substrings.remove_repeats(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    kept = found.filter("n_removed = 0 or n_removed < n_words")
    kept = kept.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    return kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens.

    A null or empty text is its end token alone. Repeated rows are packed each.
    """
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), forget=True)


STAGES = [("language", known_language), ("quality", good_quality), ("near_duplicates", one_of_each_class), ("substrings", without_repeats), ("packing", packed)]

#: The learned stages have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
