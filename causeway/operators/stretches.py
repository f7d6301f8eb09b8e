"""Running aggregates of keys with any share of the rows, by stretches of the order.

The order is cut into stretches, and a stretch is what a task sorts. Totals of
each key and stretch are summed up over the stretches before, and enter each
stretch as rows that come first: one for each key that is there. So all keys
share one shuffle, and no task holds more of a key than a stretch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a stretch has, about.
STRETCH = 50_000
#: Stretches that an order is cut into at most.
MOST = 4096


def stretch_of(rows: DataFrame, along: str, size: int):
    """A function of an instant: its stretch, by cuts at approximate quantiles of `along`, every `size` rows."""
    n = min(MOST, rows.count() // max(size, 1) + 1)
    cuts = np.array(sorted(set(rows.approxQuantile(along, [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else [], dtype="float64")

    @F.pandas_udf("int")
    def run(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, at.to_numpy(dtype="float64"), "left"), dtype="int32")

    return run


def running(rows: DataFrame, order: Sequence[str], families: Mapping[str, tuple[Sequence[str], Sequence[str]]], how: Mapping[str, str]) -> DataFrame:
    """`rows` with `<family>_<column>`: the aggregate of the column over all rows of the family's keys up to each.

    `rows` has `stretch`, which never falls along `order`; `order` is total.
    families: {family: (keys, columns)}, no two with equal keys. how: {column:
    sum, max or last}, where last is the last value that isn't null.
    """
    keys = list(dict.fromkeys(k for by, _ in families.values() for k in by))
    number = {f: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in by) for f, (by, _) in families.items()}
    placed = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v")))
    first = {c: F.max(placed(c)) if h == "last" else getattr(F, h)(c) for c, h in how.items()}
    again = {c: F.max(c) if h == "last" else getattr(F, h)(c) for c, h in how.items()}
    finest = rows.select("stretch", *keys, *dict.fromkeys([*order, *how])).repartition("stretch").groupBy("stretch", *keys).agg(*(x.alias(c) for c, x in first.items()))
    totals = finest.groupingSets([[F.col("stretch"), *(F.col(k) for k in by)] for by, _ in families.values()], "stretch", *keys).agg(F.grouping_id().cast("int").alias("_family"), *(x.alias(c) for c, x in again.items()))
    before = Window.partitionBy("_family", *keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("stretch", "_family", *keys, *((F.max(c).over(before)["v"] if h == "last" else again[c].over(before)).alias(c) for c, h in how.items()))
    starts = starts.where(" or ".join(f"`{c}` is not null" for c in how))
    stream = rows.withColumn("_family", F.lit(None).cast("int")).unionByName(starts, allowMissingColumns=True).repartition("stretch")
    for f, (by, columns) in families.items():
        over = Window.partitionBy("stretch", *by).orderBy(F.col("_family").isNull(), *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        mine = F.col("_family").isNull() | (F.col("_family") == number[f])
        value = lambda c, mine=mine: F.when(mine, F.col(c))
        stream = stream.withColumns({f"{f}_{c}": (F.last(value(c), ignorenulls=True) if how[c] == "last" else getattr(F, how[c])(value(c))).over(over) for c in columns})
    return stream.where(F.col("_family").isNull()).drop("_family")
