"""Vector best-fit packing of token sequences.

A document's ids are cut into pieces of at most `capacity` tokens. Pieces go
into bins with three capacities: tokens, documents, and attention cost (the
sum of squared lengths). Only lengths matter, and there are at most
`capacity` of them, so the histogram of lengths, of bounded size, is packed
once for the whole corpus: longest first, all pieces of a length at a time,
into groups of bins with the same residual vector. The group that fits is
chosen by weighted dot product of item and residual or by the smallest norm
of what would be left. A plan then tells each length's n-th piece its bin and
offset, and pieces find theirs by their rank among equals.

Defined results: a null text is empty, and an empty text is one piece of the
end id; repeated rows and null ids are packed each; texts of any length are
encoded whole and cut; an empty table gives an empty result; other columns, of
any name, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, order_key, running_sums
from .tokens import default_path, encoder

CAPACITY = 2048
END_ID = 0


@dataclass(frozen=True)
class Limits:
    """Capacities of a bin. At the defaults only the tokens ever bind."""

    tokens: int = CAPACITY
    documents: int | None = None
    attention: int | None = None
    #: Weights of the three dimensions in the choice of a bin.
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    #: "norm": smallest weighted norm of the residual; "dot": largest weighted dot product.
    rule: str = "norm"

    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens**2

    def check(self) -> None:
        if self.rule not in ("norm", "dot"):
            raise ValueError("rule must be norm or dot")
        if self.tokens < 1 or (self.documents or 1) < 1 or (self.attention or self.tokens**2) < self.tokens**2:
            raise ValueError("a bin must hold one piece of any length")


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, low, high, sequence, offset) of a packing.

    The n-th piece of `length` with low <= n < high is at `offset` in bin
    sequence + n - low. Bins with the same residual vector stay together as
    ranges of numbers, so the plan's size depends on the lengths, not on the
    number of pieces.
    """
    limits.check()
    full = np.array(limits.vector(), np.int64)
    scale = np.array(limits.weights) / (full.astype(float) ** 2)
    groups: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    bins = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        item = np.array((length, 1, length * length), np.int64)

        def put(state: tuple[int, int, int], ranges: list[tuple[int, int]]) -> None:
            rest = tuple(int(x) for x in np.array(state) - item)
            if rest[0] and rest[1]:
                groups.setdefault(rest, []).extend(ranges)

        while left:
            states = np.array(list(groups), np.int64).reshape(-1, 3)
            fits = np.flatnonzero((states >= item).all(axis=1))
            if not len(fits):
                # new bins; as many pieces to each as its capacities allow come by the next rounds
                per = int((full // np.maximum(item, 1)).min())
                count = -(-left // per)
                groups[tuple(int(x) for x in full)] = [(bins, bins + count)]
                bins += count
                continue
            if limits.rule == "dot":
                best = fits[np.argmax((states[fits] * item * scale).sum(axis=1))]
            else:
                after = (states[fits] - item).astype(float)
                best = fits[np.argmin((after * after * scale).sum(axis=1))]
            state = tuple(int(x) for x in states[best])
            ranges, used = groups.pop(state), []
            while ranges and left:
                low, high = ranges.pop()
                n = min(left, high - low)
                rows.append((length, rank, rank + n, low, int(full[0]) - state[0]))
                used.append((low, low + n))
                rank, left = rank + n, left - n
                if low + n < high:
                    ranges.append((low + n, high))
            if ranges:
                groups[state] = ranges
            put(state, used)
    return rows


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Encode `docs` and cut: only documents longer than `capacity`, the first piece being the short one."""
    path = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], encode.dtype).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(encode(text.as_py() or "") + end, encode.dtype).astype("<u4")
                bounds = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    for column, x in zip(out, (key, i, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def packed(docs: DataFrame, tokenizer: str | None = None, limits: Limits = Limits(), end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    limits.check()
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, limits.tokens, end_id)
    cut = materialise(cut.withColumn("order_key", order_key(F.col("doc_id"), F.col("piece"), F.col("ids_crc32"))), "pieces")
    # at most `tokens` lengths, so both this table and the plan are bounded
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.createDataFrame(plan(histogram, limits), "of_length long, low long, high long, sequence long, at long")
    ranked = running_sums(cut, ["length"], ["doc_id", "piece", "ids_crc32"], {"rank": F.lit(1).cast("long")})
    here = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(F.broadcast(table), here).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"),
        F.col("at").alias("offset"),
    )
