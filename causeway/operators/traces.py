"""Traces as a sorted stream: a task reads one after another and gives each to a function, many to a batch.

A group a call of pandas costs milliseconds whatever its length; here a trace
costs what its function does. A trace is held whole, no task holds two long
ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: From the columns of a trace, in order, to the new columns, a value per row.
Run = Callable[[dict[str, np.ndarray]], Sequence[np.ndarray]]


def starts(batch: pa.RecordBatch, by: Sequence[str]) -> list[int]:
    """Where a trace begins in a batch of sorted rows; nulls are a key like others."""
    ends = [pc.run_end_encode(batch.column(c)).run_ends.to_numpy() for c in by]
    return np.unique(np.concatenate([[0], *ends]))[:-1].tolist()


def per_trace(rows: DataFrame, by: Sequence[str], order: Sequence[str], keep: Sequence[str], run: Run, new: str) -> DataFrame:
    """`keep` of `rows` and the columns `new` (names and types) that `run` makes of each trace, in order of `order`."""
    by, keep = list(by), list(keep)
    made = StructType.fromDDL(new)
    schema = StructType([*(rows.schema[c] for c in keep), *made.fields])
    kinds = [to_arrow_type(f.dataType) for f in made.fields]

    def played(batch: pa.RecordBatch, cuts: list[int]) -> pa.RecordBatch:
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        parts = [run({n: c[a:b] for n, c in columns.items()}) for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True)]
        fresh = [pa.array(np.concatenate([p[i] for p in parts]), kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *fresh], names=schema.names)

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the trace that the last batch ended in
        key = lambda batch, i: [batch.column(c)[i].as_py() for c in by]
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = starts(batch, by)
            at = 0
            if held:
                if key(held[-1], held[-1].num_rows - 1) == key(batch, 0):
                    at = 1
                    held.append(batch.slice(0, cuts[1]) if len(cuts) > 1 else batch)
                    if len(cuts) == 1:
                        continue
                yield played(whole(held), [0])
            if at < len(cuts) - 1:
                yield played(batch.slice(cuts[at], cuts[-1] - cuts[at]), [c - cuts[at] for c in cuts[at:-1]])
            held = [batch.slice(cuts[-1])]
        if held:
            yield played(whole(held), [0])

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(task, schema)
