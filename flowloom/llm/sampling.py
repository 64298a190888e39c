"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text is the multiset of its words. For each of ``SAMPLES`` draws a word with count w gets, from its own hashes alone,
r and c from Gamma(2, 1) and b from [0, 1), with t = floor(ln w / r + b), and the word with the smallest
ln c - r (t - b + 1) is drawn together with its t. Two texts draw the same with a chance of sum min(w) / sum max(w), their
generalised Jaccard similarity, so the share of equal draws estimates it. A draw is one long, its value above its name,
so a text's draws are plain minima.

The next document is found inside ranges of ids: the texts are sent once, by range, and each range also gets the first
document of the range behind it.

Nulls and edges: a null text is empty; a text without words has the fingerprint of zeros, and two such are alike (1).
Rows of one ``doc_id`` follow one another by text. Rows without ``doc_id`` follow one another by text inside groups of their
own; the last of a group is followed by an empty text. An empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
#: Ranges of ids per shuffle partition.
RANGES = 4
_NAME_BITS, _VALUE_STEPS, _VALUE_SHIFT = 29, 1 << 27, 64


def _uniform(bits: Column, skip: int) -> Column:
    """21 bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(bits, skip).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) / F.lit(float(1 << 21))


def draw(k: int, word: Column, log_count: Column) -> Column:
    """Draw k of one word: its value in the upper bits, its name in the lower ones."""
    one, two = F.xxhash64(word, F.lit(2 * k)), F.xxhash64(word, F.lit(2 * k + 1))
    r = -F.log(_uniform(one, 0) * _uniform(one, 21))
    log_c = F.log(-F.log(_uniform(one, 42) * _uniform(two, 0)))
    b = _uniform(two, 21)
    t = F.floor(log_count / r + b)
    value = F.floor((log_c - r * (t - b + 1) + F.lit(_VALUE_SHIFT)) * F.lit(float(_VALUE_STEPS))).cast("long")
    name = (F.shiftrightunsigned(two, 42) + t * F.lit(0x9E3779B1)).bitwiseAND(F.lit((1 << _NAME_BITS) - 1))
    # Values lie within 2 ** 7 of the shift for any count a text can have; the ends are held all the same.
    return F.shiftleft(F.greatest(F.lit(0), F.least(value, F.lit((1 << 34) - 1))), _NAME_BITS).bitwiseOR(name)


def _range_of(doc_id: Column, bounds: list[int], low: int = 0) -> Column:
    """Number of bounds that are not above the id, by halving."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(doc_id < bounds[mid], _range_of(doc_id, bounds[:mid], low)).otherwise(_range_of(doc_id, bounds[mid + 1 :], low + mid + 1))


def with_next(docs: DataFrame) -> DataFrame:
    """range, pos, doc_id, is_copy, text and next_text; ``is_copy`` marks the first document of a later range."""
    spark = docs.sparkSession
    wanted = max(1, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)] or [0.5], 20 * wanted)).first()[0]
    bounds = sorted(set(cuts or []))
    own_groups = F.lit(len(bounds) + 1) + F.pmod(F.xxhash64("text"), F.lit(wanted)).cast("int")
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), own_groups).otherwise(_range_of(F.col("doc_id"), bounds)))
    # One row a range: bounded by the number of ranges.
    firsts = sorted((r["doc_id"], r["range"]) for r in rows.filter("doc_id is not null").groupBy("range").agg(F.min("doc_id").alias("doc_id")).collect())
    before = [(doc_id, firsts[i - 1][1]) for i, (doc_id, _) in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(before, "doc_id long, range int"))
    copies = rows.select("doc_id", "text").join(heads, "doc_id").select("doc_id", "text", "range", F.lit(True).alias("is_copy"))
    every = rows.withColumn("is_copy", F.lit(False)).select("doc_id", "text", "range", "is_copy").unionByName(copies)
    order = Window.partitionBy("range").orderBy("is_copy", "doc_id", "text")
    return every.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit(""))).withColumn("pos", F.row_number().over(order))


def edited(text: Column, next_text: Column) -> Column:
    """The last half of a text replaced by as much of the beginning of the next one."""
    size = F.char_length(text)
    half = F.floor(size / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (size - half).cast("int")), F.substring(next_text, F.lit(1), half))


def likeness(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.lit(float(SAMPLES))


def _printed(draws: Column) -> Column:
    return F.array_join(F.transform(draws, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    # Kind 0 and 1: the words of both texts; kind 2: what is known of the row itself.
    none = F.lit(None).cast("string")
    row = F.struct(F.lit(2).alias("kind"), F.lit("").alias("t"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("sha"), F.char_length("text").cast("long").alias("n"))
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("t"), none.alias("sha"), F.lit(0).cast("long").alias("n")) for k, c in enumerate(("text", "edited"))]
    parts = rows.select("range", "pos", "doc_id", F.explode(F.when(F.col("is_copy"), F.array(kinds[0])).otherwise(F.array(*kinds, row))).alias("x"))
    words = parts.select("range", "pos", "doc_id", "x.kind", "x.sha", "x.n", F.explode(F.split("x.t", "[ \\t-\\r]+")).alias("word")).filter("word != '' or kind = 2")
    counted = words.groupBy("range", "pos", "doc_id", "kind", "sha", "n", F.xxhash64("word").alias("word")).agg(F.log(F.count("*").cast("double")).alias("log_count"))
    keys = ["range", "pos", "doc_id", "kind", "sha", "n"]
    drawn = counted.groupBy(*keys).agg(*[F.min(draw(k, F.col("word"), F.col("log_count"))).alias(f"d{k}") for k in range(SAMPLES)])
    names = F.array(*[F.col(f"d{k}").bitwiseAND(F.lit((1 << _NAME_BITS) - 1)) for k in range(SAMPLES)])
    drawn = drawn.select(*keys, names.alias("draws"))
    empty = F.array(*[F.lit(0).cast("long")] * SAMPLES)
    kind = F.col("kind")
    by_row = drawn.groupBy("range", "pos", "doc_id").agg(
        F.coalesce(F.max(F.when(kind == 0, F.col("draws"))), empty).alias("own"),
        F.coalesce(F.max(F.when(kind == 1, F.col("draws"))), empty).alias("edit"),
        F.max(F.when(kind == 2, F.col("sha"))).alias("edited_sha256"),
        F.max(F.when(kind == 2, F.col("n"))).alias("n_chars"),
    )
    order = Window.partitionBy("range").orderBy("pos")
    placed = by_row.withColumn("next", F.lead("own").over(order)).withColumn("after", F.lead("pos").over(order))
    # A copy without words has no row; the fingerprint behind is then the empty one.
    following = F.when(F.col("after") == F.col("pos") + 1, F.col("next")).otherwise(empty)
    return placed.filter("n_chars is not null").select(
        "doc_id", "n_chars", "edited_sha256", _printed(F.col("own")).alias("fingerprint"), _printed(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), following).alias("near_next"),
    )


def expected_error(samples: int = SAMPLES) -> float:
    """Largest standard deviation of a likeness."""
    return math.sqrt(0.25 / samples)
