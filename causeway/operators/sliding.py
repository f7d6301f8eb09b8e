"""Order statistics of the last results of a key, in one pass over its sorted stream."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: Results in a rolling window.
RECENT = 120


def place(n: int, p: float) -> int:
    """Where the nearest-rank quantile of n sorted values stands, from 0."""
    return min(n - 1, int(p * (n - 1) + 0.5))


def sliding(stream: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float] = (0.5, 0.9), size: int = RECENT) -> DataFrame:
    """(job_id, n, p.., top) for each read: quantiles and maximum of the last `size` results of its key.

    A sorted list of the last values goes along: a result enters and the oldest
    leaves by bisection, and nothing is sorted again.

    `stream` has at_us, kind, job_id, the key and the value, which isn't null
    in results. It is shuffled by key once and sorted; a task holds `size`
    values, whatever the share of rows that a key has.
    """
    names = [f"p{round(100 * p)}" for p in quantiles]
    kind_of = stream.schema[value].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, ordered = object(), deque(), []
        for batch in batches:
            jobs, counts, out = [], [], [[] for _ in range(len(quantiles) + 1)]
            kinds, ids, values = (batch.column(c).to_pylist() for c in ("kind", "job_id", value))
            for key, kind, job, x in zip(zip(*(batch.column(c).to_pylist() for c in by), strict=True), kinds, ids, values, strict=True):
                if key != current:
                    current, last, ordered = key, deque(), []
                if kind == 1:
                    n = len(ordered)
                    jobs.append(job)
                    counts.append(n)
                    for column, p in zip(out, quantiles, strict=False):
                        column.append(ordered[place(n, p)] if n else None)
                    out[-1].append(ordered[-1] if n else None)
                elif kind != 2:
                    if len(last) == size:
                        del ordered[bisect_left(ordered, last.popleft())]
                    last.append(x)
                    insort(ordered, x)
            kind = pa.from_numpy_dtype({"bigint": "i8", "int": "i4", "double": "f8"}[kind_of])
            yield pa.RecordBatch.from_arrays([pa.array(jobs, pa.int64()), pa.array(counts, pa.int32()), *(pa.array(c, kind) for c in out)], names=["job_id", "n", *names, "top"])

    rows = stream.where("kind <> 2").select(*by, "at_us", "kind", "job_id", value).repartition(*by).sortWithinPartitions(*by, "at_us", "kind", "job_id")
    return rows.mapInArrow(run, ", ".join(["job_id long", "n int", *(f"{c} {kind_of}" for c in (*names, "top"))]))
