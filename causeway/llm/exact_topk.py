"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are cut into segments of equal length, give or take one. With mean m
and deviation d of each segment of length L, the squared distance of two
vectors is at least sum L ((m - m')^2 + (d - d')^2), so their inner product is
at most sum L (m m' + d d'). Bounds go from few segments to many; candidates
whose bound is under a query's known k-th score are out, and survivors are
scored exactly, in integers.

Rows are dealt evenly into blocks, and each query block meets each candidate
block once, in the task of that block. A query's first k-th score comes from one block that all query
blocks see first; its size is bounded, so it is broadcast.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows without an id; a query meets candidates of its own
length only and not rows of its own id; of repeated query ids the smallest
vector asks; repeated candidates count each; ties go to the smaller id; an
empty table gives an empty result; other columns, of any name, are not read.
Scores are 64-bit integers: components up to a million, in vectors of up to a
thousand of them, stay within that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

K = 20
QUERY_EVERY = 20
SCALE = 64
#: Rows of a block, and queries of a query block.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 1_024
#: Segments of each resolution, coarse to fine; shorter vectors use those with fewer segments than components.
RESOLUTIONS = (4, 16)
#: Share of pairs under which survivors are scored one by one.
SPARSE = 0.02

_BLOCK = "block int, dim int, ids binary, vectors binary"


def valid(vector: Column) -> Column:
    """Vectors of finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def blocks(rows: DataFrame, per_block: int) -> DataFrame:
    """`rows` (id long, vector array<long>, dim int) of one length as blocks, numbered from 0 without gap."""
    count = max(1, -(-rows.count() // per_block))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, vectors, dim = [], [], 0
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy(zero_copy_only=False))
                vectors.append(batch.column(1).flatten().to_numpy(zero_copy_only=False))
                dim = batch.column(2)[0].as_py()
        flat = np.concatenate(vectors) if vectors else np.empty(0, np.int64)
        keys = np.concatenate(ids) if ids else np.empty(0, np.int64)
        number = pa.array([TaskContext.get().partitionId()], pa.int32())
        yield pa.RecordBatch.from_arrays([number, pa.array([dim], pa.int32()), pa.array([keys.astype("<i8").tobytes()]), pa.array([narrow(flat).tobytes()])], names=["block", "dim", "ids", "vectors"])

    return rows.select("id", "vector", "dim").repartition(count).mapInArrow(pack, _BLOCK)


def narrow(x: np.ndarray) -> np.ndarray:
    """`x` in the fewest bytes that hold it."""
    low, high = x.min(initial=0), x.max(initial=0)
    return x.astype(next(f"<i{n}" for n in (1, 2, 4, 8) if -(1 << 8 * n - 1) <= low and high < 1 << 8 * n - 1))


def unpacked(dim: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, "<i8")
    width = len(vectors) // max(1, len(keys) * dim) or 8
    return keys, np.frombuffer(vectors, f"<i{width}").reshape(-1, max(1, dim)).astype(np.int64)


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, times the root of its length, side by side."""
    cuts = np.linspace(0, vectors.shape[1], segments + 1).astype(np.int64)
    parts = [vectors[:, a:b].astype(np.float64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    roots = np.sqrt(np.diff(cuts))
    return np.concatenate([np.stack([f(x, axis=1) for x in parts], axis=1) * roots for f in (np.mean, np.std)], axis=1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def block_top(queries: tuple, candidates: tuple, least: np.ndarray, k: int, resolutions=RESOLUTIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the k best of a block for each query, `least` bounding what matters."""
    (qid, q), (cid, c) = queries, candidates
    none = np.empty(0, np.int64)
    if not len(qid) or not len(cid):
        return none, none, none
    alive = qid[:, None] != cid[None, :]
    for segments in resolutions:
        if segments >= q.shape[1]:
            continue
        mine, theirs = segment_statistics(q, segments), segment_statistics(c, segments)
        # terms may cancel, so rounding goes with the lengths and not with the bound
        slack = np.linalg.norm(mine, axis=1)[:, None] * (1e-9 * np.linalg.norm(theirs, axis=1))[None, :]
        alive &= mine @ theirs.T + slack + 1e-6 >= least[:, None]
        keep = alive.any(axis=0)  # candidates that no query needs leave at once
        if not keep.all():
            cid, c, alive = cid[keep], c[keep], alive[:, keep]
            if not len(cid):
                return none, none, none
    if alive.mean() < SPARSE:
        row, at = np.nonzero(alive)
        score = np.concatenate([(q[row[i : i + 65536]] * c[at[i : i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536)]) if len(row) else none
    else:
        score = exact_products(q, c)
        floor = np.iinfo(np.int64).min
        score[~alive] = floor
        n = min(k, score.shape[1])
        cut = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
        row, at = np.nonzero((score >= np.maximum(cut, np.ceil(least).astype(np.int64))[:, None]) & (score > floor))
        score = score[row, at]
    order = np.lexsort((cid[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    start = np.searchsorted(row, row)
    best = np.arange(len(row)) - start < k
    return row[best], cid[at[best]], score[best]


def with_least(asked: DataFrame, seed: DataFrame, k: int) -> DataFrame:
    """Query blocks with each query's k-th score in the seed block, a lower bound of its k-th at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                queries, seeds = unpacked(r["dim"], r["ids"], r["vectors"]), unpacked(r["dim"], r["seed_ids"], r["seed_vectors"])
                # far under any score, yet small enough for the bounds' arithmetic
                least = np.full(len(queries[0]), -(2.0**62))
                row, _, score = block_top(queries, seeds, least, k)
                last = np.flatnonzero(np.bincount(row, minlength=len(least)) == k)
                ends = np.searchsorted(row, last, "right") - 1
                least[last] = score[ends]
                arrays = [pa.array([r["block"]], pa.int32()), pa.array([r["dim"]], pa.int32()), pa.array([r["ids"]]), pa.array([r["vectors"]]), pa.array([least.tobytes()])]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "dim", "ids", "vectors", "least"])

    seeds = seed.select(F.col("ids").alias("seed_ids"), F.col("vectors").alias("seed_vectors"), "dim")
    return asked.join(F.broadcast(seeds), "dim").select("block", "dim", "ids", "vectors", "seed_ids", "seed_vectors").mapInArrow(run, _BLOCK + ", least binary")


def ranked(found: DataFrame, k: int, score: str = "score") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score)


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of `vectors` (vec_id, embedding)."""
    rows = vectors.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding"), scale).alias("vector"), F.size("embedding").alias("dim")
    )
    rows = materialise(rows, "quantised")
    out = None
    for dim in [r.dim for r in rows.select("dim").distinct().orderBy("dim").collect()]:  # one length as a rule
        own = rows.where(F.col("dim") == dim)
        asks = own.where(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min("vector").alias("vector"))
        candidates = materialise(blocks(own, BLOCK_ROWS), "blocks")
        asked = materialise(with_least(blocks(asks, BLOCK_QUERIES), candidates.where("block = 0"), k), "asked")
        count = candidates.agg(F.max("block")).first()[0] + 1

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            others = None
            for batch in batches:
                for i in range(batch.num_rows):
                    r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                    own = unpacked(r["dim"], r["ids"], r["vectors"])
                    if r["least"] is None:
                        others = own
                        continue
                    row, vec, score = block_top(own, others, np.frombuffer(r["least"]), k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[0][row]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

        # a stream in place of a join, which Spark may send whole through the driver: a block of candidates, then all queries
        pairs = asked.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        others = candidates.select("dim", "ids", "vectors", F.col("block").alias("c_block"), F.lit(None).cast("int").alias("block"), F.lit(None).cast("binary").alias("least"))
        stream = others.unionByName(pairs).repartition(count, "c_block").sortWithinPartitions("c_block", F.col("block").asc_nulls_first())
        found = stream.select("dim", "ids", "vectors", "least").mapInArrow(meet, "query_id long, vec_id long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return ranked(out, k)
