"""A hash order that any SQL engine can reproduce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Width of the hash: 13 hexadecimal digits, exact as a double.
HASH_RANGE = 16**13


def hash_order(keys: Sequence[str], seed: int = 42) -> Column:
    """Integer in [0, 16^13) from the first md5 digits of ``seed:key|key``."""
    text = F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def hash_order_sql(keys: str, seed: int = 42) -> str:
    """The same value as checking SQL; ``keys`` is a text expression."""
    return f"cast('0x' || substr(md5('{seed}:' || {keys}), 1, 13) as bigint)"
