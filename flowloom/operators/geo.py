"""Address to location by address ranges, nested and overlapping ones included, IPv4 and IPv6."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.lineage import cut
from flowloom.functions.net import address_key, ipv4_key

#: Hex digits that one level of the search decides; a node has at most 16 ** STEP children.
STEP = 4
BITS = 4 * STEP
FULL = 2**BITS - 1
#: Levels per family: 32 and 128 bits.
LEVELS = {"4": 2, "6": 8}


def _digit(key: Column, level: int) -> Column:
    """The number that the hex digits of a level spell."""
    return F.conv(F.substring(key, 2 + STEP * (level - 1), STEP), 16, 10).cast("int")


def _runs(family: str) -> Column:
    """A range as runs of sibling nodes ``(_parent, lo, hi)``: at most two on each level, which cover it exactly."""
    last, s, e = LEVELS[family], F.col("_start"), F.col("_end")
    found = []
    for level in range(1, last + 1):
        inner = 0 if level == last else 1
        at, below = 1 + STEP * (level - 1), 1 + STEP * level
        left, right = F.substring(s, 1, at), F.substring(e, 1, at)
        split = F.substring(s, 1, below) != F.substring(e, 1, below) if inner else F.lit(True)

        def run(cond: Column, parent: Column, lo: Column, hi: Column) -> Column:
            return F.when(cond & (lo <= hi), F.struct(parent.alias("parent"), lo.alias("lo"), hi.alias("hi")))

        found += [
            run((left == right) & split, left, _digit(s, level) + inner, _digit(e, level) - inner),
            run(left != right, left, _digit(s, level) + inner, F.lit(FULL)),
            run(left != right, right, F.lit(0), _digit(e, level) - inner),
        ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _aligned(run: Column) -> Column:
    """A run as aligned blocks ``(parent, bits, at)`` of ``2 ** bits`` siblings each, as few as possible."""

    def blocks(bits: int) -> Column:
        first = lambda b: F.shiftright(run["lo"] + (2**b - 1), b)
        stop = lambda b: F.shiftright(run["hi"] + 1, b)
        a, z = first(bits), stop(bits)
        coarser = first(bits + 1) < stop(bits + 1)
        odd = F.filter(F.array(F.when(a % 2 == 1, a), F.when(z % 2 == 1, z - 1)), lambda x: x.isNotNull())
        at = F.when(coarser, odd).when(a < z, F.sequence(a, z - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(run["parent"].alias("_parent"), F.lit(bits).alias("_bits"), i.alias("_at")))

    return F.flatten(F.array(*[blocks(b) for b in range(BITS + 1)]))


def _owned_blocks(ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blocks of siblings with the range that owns them: the latest start, then the earliest end, then the largest columns."""
    text = isinstance(ranges.schema["start_ip"].dataType, T.StringType)
    key = address_key if text else ipv4_key
    ends = ranges.select(key(F.col("start_ip")).alias("_start"), key(F.col("end_ip")).alias("_end"), *columns)
    ends = ends.where((F.col("_start") <= F.col("_end")) & (F.substring("_start", 1, 1) == F.substring("_end", 1, 1)))
    # A digit-wise complement turns the earliest end into the largest text.
    early = F.translate("_end", "0123456789abcdef", "fedcba9876543210")
    owner = F.struct("_start", early.alias("_early"), *columns).alias("_owner")
    out = None
    for family in LEVELS if text else ("4",):
        runs = ends.where(F.col("_start").startswith(family)).select(owner, F.explode(_runs(family)).alias("run"))
        part = runs.select("_owner", F.inline(_aligned(F.col("run"))))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("_parent", "_bits", "_at").agg(F.max("_owner").alias("_owner"))


def locate(addresses: DataFrame, ip: str, ranges: DataFrame, columns: Sequence[str] = ("country",)) -> DataFrame:
    """Location columns per distinct address, null outside all ranges and for texts that are no address.

    Ranges have inclusive ends ``start_ip`` and ``end_ip``, IPv4 numbers or texts of either family. They may nest and overlap:
    of the ranges that hold an address the one with the latest start decides, among these the earliest end, then the
    largest columns, so the innermost of nested ranges wins. Ranges with null, malformed or reversed ends hold nothing.

    The search goes down the address 16 bits at a time. Ranges become blocks of sibling nodes, at most 30 for every
    run; a node asks for the 17 blocks that may hold it and inherits what its parent has found. No join key has more than 65 536
    rows a side, whatever the ranges, and no pairs of address and range are formed.
    """
    blocks = cut(_owned_blocks(ranges, columns))
    distinct = cut(addresses.select(F.col(ip).alias("_ip")).distinct().withColumn("_key", address_key(F.col("_ip"))))
    families = LEVELS if isinstance(ranges.schema["start_ip"].dataType, T.StringType) else {"4": LEVELS["4"]}
    known = distinct.where(F.substring("_key", 1, 1).isin(*families)).select("_key")
    found, owned = None, None
    for level in range(1, max(families.values()) + 1):
        width = 1 + STEP * level
        nodes = known.where(F.length("_key") >= width).select(F.substring("_key", 1, width).alias("_node")).distinct()
        asked = F.array(*[F.struct(F.lit(b).alias("_bits"), F.shiftright(_digit(F.col("_node"), level), b).alias("_at")) for b in range(BITS + 1)])
        asking = nodes.select("_node", F.substring("_node", 1, width - STEP).alias("_parent"), F.inline(asked))
        answers = blocks.where(F.length("_parent") == width - STEP)
        if owned is not None:  # what holds the parent holds the block of all its children
            answers = answers.unionByName(owned.select(F.col("_node").alias("_parent"), F.lit(BITS).alias("_bits"), F.lit(0).alias("_at"), "_owner"))
        owned = asking.join(answers, ["_parent", "_bits", "_at"]).groupBy("_node").agg(F.max("_owner").alias("_owner"))
        if level in families.values():
            done = owned.where(F.substring("_node", 1, 1).isin(*[f for f, n in families.items() if n == level]))
            found = done if found is None else found.unionByName(done)
    out = distinct.join(found.withColumnRenamed("_node", "_key"), "_key", "left")
    return out.select(F.col("_ip").alias(ip), *[F.col("_owner")[c].alias(c) for c in columns])


def with_location(df: DataFrame, ip: str, ranges: DataFrame, columns: Sequence[str] = ("country",)) -> DataFrame:
    """Attach the location to every row; a busy address is left to the skew join."""
    return df.join(locate(df, ip, ranges, columns), ip, "left")
