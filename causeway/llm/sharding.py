"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each record draws a number for every shard from its key and the shard's
number, and goes to the shard with the largest weighted draw. One more shard
takes records only into itself: among the old shards no draw changes.

Main path: DataFrame functions only.

Defined results: a null text has size 8 and the crc32 of nothing (0); a null
doc_id is one key; repeated rows go to the same shard under different slots;
texts are read whole; an empty table gives an empty result; other columns, of
any name, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, order_key, running_sums

SHARDS = 24
#: Bytes that a record takes beside its text.
OVERHEAD = 8


def rendezvous(key: Column, shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard of a key: largest weight / -ln(draw), the smaller shard at ties."""
    if weights is not None and len(weights) != shards:
        raise ValueError("one weight per shard")
    if shards < 1 or weights is not None and min(weights) <= 0:
        raise ValueError("shards and weights must be positive")

    def score(i: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, i), 11)
        if weights is None:  # the logarithm keeps the order of the draws
            return bits
        draw = (bits.cast("double") + 0.5) * F.lit(2.0**-53)
        return F.element_at(F.array(*(F.lit(float(w)) for w in weights)), i + 1) / -F.log(draw)

    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(score(i).alias("s"), (-i).alias("i")))
    return (-F.array_max(draws)["i"]).cast("int")


def sharded(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """One row per document with its shard, its slot there and its shard if one is added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    grown = None if weights is None else [*weights, grown_weight]
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), shards, weights).alias("shard"),
        rendezvous(F.col("doc_id"), shards + 1, grown).alias("grown_shard"),
        order_key(F.col("doc_id")).alias("order_key"),
    )
    rows = materialise(rows, "shards")
    placed = running_sums(rows, ["shard"], ["doc_id", "size", "text_crc32"], {"slot": F.lit(1).cast("long")})
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
