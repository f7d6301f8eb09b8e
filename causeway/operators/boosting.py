"""Histogram gradient boosting as DataFrame jobs, for many models at once.

Rows carry the key of the model that they train (a target term, a seed, both),
and all models grow together, level by level. A level is one aggregation, by
arrays in the tasks while their cells are few:
gradients and hessians summed by (model, node, feature, bin), combined map-side,
so that what is shuffled has a row per cell and task and no training row ever
moves; rows lie in blocks of one model then, a row of Spark each, and a block that takes its leaves counts the next root. Running sums over the bins of a cell give the gain of every cut; the
best one of each node, and nothing else, comes to the driver.

Features are cut at quantiles of each model's own training rows. Gradients are
whole multiples of 2^-20, so their sums don't depend on the order of rows:
reruns, lost executors and other partitionings give the same trees.

A model is a row of a table: start score, cuts, trees as heaps. Scoring joins
rows with it by key, so a saved model scores changed histories without a refit.

Losses: `tweedie` (variance power 1.5, log link), `log` (squared error of
log(1 + y)), `logistic` (y 0 or 1). Missing features are a bin of their own,
below all others. Rows without label or key are not learned from; a model
without rows doesn't exist, and rows scored by it get null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..sources.scratch import dropped, written

#: Fixed point of gradients and hessians.
UNIT = 1 << 20
#: Accuracy of the sketch that brackets a quantile, which bounds its memory; the quantile itself is exact.
SKETCH = 10_000
#: Models whose trees are sent to the tasks; more are joined by a shuffle.
MOST_SENT = 10_000
#: Cells (model, node, feature, bin) that a task sums in arrays; more go by rows.
MOST_CELLS = 1 << 20
#: Rows of a block of one model, and rows that a task holds in unfinished blocks of all models.
BLOCK_ROWS, HELD_ROWS = 1 << 15, 1 << 20


@dataclass(frozen=True)
class Boosting:
    loss: str = "tweedie"
    rounds: int = 40
    depth: int = 4
    rate: float = 0.1
    shrink: float = 1.0
    least_rows: int = 20
    least_gain: float = 1e-6
    bins: int = 32

    def __post_init__(self):
        if self.loss not in _LOSSES:
            raise ValueError(f"loss must be one of {', '.join(_LOSSES)}")


#: Per loss: start score from the mean label, label as learned, gradient, hessian, prediction.
_LOSSES = {
    "tweedie": (F.log, lambda y: y, lambda y, s: F.exp(F.lit(0.5) * s) - y * F.exp(F.lit(-0.5) * s), lambda y, s: F.lit(0.5) * F.exp(F.lit(0.5) * s) + F.lit(0.5) * y * F.exp(F.lit(-0.5) * s), F.exp),
    "log": (lambda m: m, F.log1p, lambda y, s: s - y, lambda y, s: F.lit(1.0), F.expm1),
    "logistic": (lambda m: F.log(m / (F.lit(1.0) - m)), lambda y: y, lambda y, s: F.lit(1.0) / (F.lit(1.0) + F.exp(-s)) - y, lambda y, s: F.exp(-s) / ((F.lit(1.0) + F.exp(-s)) * (F.lit(1.0) + F.exp(-s))), lambda s: F.lit(1.0) / (F.lit(1.0) + F.exp(-s))),
}
#: Start scores of one-sided labels stay finite.
LEAST_MEAN = 1e-6

_TREE = StructType([StructField("feature", ArrayType(IntegerType())), StructField("cut", ArrayType(IntegerType())), StructField("leaf", ArrayType(DoubleType()))])


def _on(by: Sequence[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]


def _keyed(table: DataFrame, by: Sequence[str]) -> DataFrame:
    return table.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})


def _attached(rows: DataFrame, table: DataFrame, by: Sequence[str], models: int, how: str = "inner") -> DataFrame:
    """`rows` with the columns of `table`, which has a row per model."""
    side = _keyed(table, by)
    return rows.join(F.broadcast(side) if models <= MOST_SENT else side, _on(by), how).drop(*(f"_k{i}" for i in range(len(by))))


def _local(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A small table of the driver, without a job."""
    kinds = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds), schema)


def _value(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def _at_ranks(counts: DataFrame, by: Sequence[str], along: Sequence[str], bins: int, take: Column) -> DataFrame:
    """(by, hits): `take` where the rows counted in `n` reach each of the ranks that bound `bins` bins; null without rows."""
    order = Window.partitionBy(*by).orderBy(*along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = counts.withColumns({"_to": F.sum("n").over(order), "_all": F.sum("n").over(Window.partitionBy(*by))})
    ranks = [F.greatest(F.ceil(F.col("_all") * F.lit(i / bins)), F.lit(1)) for i in range(1, bins)]
    return steps.groupBy(*by).agg(F.array(*(F.max(F.when((F.col("_to") >= r) & (F.col("_to") - F.col("n") < r), take)) for r in ranks)).alias("hits"))


def cut_points(rows: DataFrame, by: Sequence[str], features: Sequence[str], bins: int) -> DataFrame:
    """(by, cuts): per feature the different quantiles that bound `bins` bins, by counts of all values."""
    each = rows.select(*by, F.posexplode(F.array(*map(_value, features))).alias("_f", "_v"))
    counts = each.groupBy(*by, "_f", "_v").agg(F.count("_v").alias("n"))
    per = _at_ranks(counts, [*by, "_f"], ["_v"], bins, F.col("_v")).select(*by, F.struct("_f", F.array_distinct(F.array_compact("hits")).alias("c")).alias("_c"))
    return per.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("_c")), lambda c: c["c"]).alias("cuts"))


def _merged(intervals: np.ndarray) -> np.ndarray:
    """Closed intervals (a row each) as disjoint ones, rising."""
    out: list[list[float]] = []
    for low, high in sorted(map(tuple, intervals.tolist())):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return np.array(out)


def _bracketed(bounds: dict[tuple[int, int], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (m, features) counts of the values inside the bounds of a model's feature; those beyond count together, above the end below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(0).to_numpy()
            x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)]
            out = []
            for k in np.unique(m).tolist():
                own = m == k
                for f, column in enumerate(x):
                    if (k, f) in bounds:
                        v, (low, high) = column[own], bounds[k, f].T
                        v = v[~np.isnan(v)]
                        at = np.searchsorted(low, v, "right") - 1
                        inside = (at >= 0) & (v <= high[at])
                        ends, n = np.unique(at[~inside], return_counts=True)
                        values, some = np.unique(v[inside], return_counts=True)
                        value = np.concatenate([values, np.where(ends >= 0, high[ends], -np.inf)])
                        beyond = np.repeat(np.array([0, 1]), [len(values), len(ends)])
                        out.append((np.full(len(value), k), np.full(len(value), f), value, beyond, np.concatenate([some, n])))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["_m", "feature", "value", "beyond", "n"])

    return run


def few_cuts(rows: DataFrame, models: int, features: Sequence[str], bins: int) -> list[list[np.ndarray]]:
    """The cuts of models 0, 1, .. in column _m: a sketch brackets each quantile, and values inside the brackets are counted one by one.

    A rank that a bracket misses falls between two of them, and that stretch
    is counted next, so the quantiles are exact whatever the sketch says.
    """
    shares = [min(1.0, max(0.0, i / bins + d)) for i in range(1, bins) for d in (-2 / SKETCH, 2 / SKETCH)]
    sketch = rows.groupBy("_m").agg(*(F.percentile_approx(_value(c), F.array(*map(F.lit, shares)), F.lit(SKETCH)).alias(f"_q{f}") for f, c in enumerate(features)))
    bounds = {(r["_m"], f): _merged(np.reshape(r[f"_q{f}"], (-1, 2))) for r in sketch.collect() for f in range(len(features)) if r[f"_q{f}"] is not None}
    cuts = [[np.empty(0)] * len(features) for _ in range(models)]
    doubles = rows.select("_m", *(F.col(c).cast("double").alias(f"_x{f}") for f, c in enumerate(features)))
    while bounds:
        counts = doubles.mapInArrow(_bracketed(bounds), "_m int, feature int, value double, beyond int, n long")
        counts = counts.repartition("_m", "feature").groupBy("_m", "feature", "value", "beyond").agg(F.sum("n").alias("n"))
        missed = {}
        for r in _at_ranks(counts, ["_m", "feature"], ["value", "beyond"], bins, F.struct("value", "beyond")).collect():
            key, low = (r["_m"], r["feature"]), bounds[r["_m"], r["feature"]][:, 0]
            gaps = [(h["value"], min(low[low > h["value"]], default=np.inf)) for h in r["hits"] if h["beyond"]]
            if gaps:
                missed[key] = _merged(np.concatenate([bounds[key], gaps]))
            else:
                cuts[key[0]][key[1]] = np.unique([h["value"] for h in r["hits"]])
        bounds = missed
    return cuts


def bins_of(features: Sequence[str]) -> Column:
    """Per feature 0 for missing, else 1 and the number of cuts below it; reads a column cuts."""
    x = F.array(*(F.col(c).cast("double") for c in features))
    one = lambda v, cuts: F.when(v.isNull() | F.isnan(v), 0).otherwise(1 + F.size(F.filter(cuts, lambda c: c < v)))
    return F.zip_with(x, F.col("cuts"), one)


def walk(levels: int) -> Column:
    """The node, from 1, that a row's bins lead to after so many levels of a tree in columns feature and cut."""
    if levels == 0:
        return F.lit(1)
    right = lambda node: F.coalesce(F.get("bins", F.get("feature", node)) > F.get("cut", node), F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(1), lambda node, _: node * 2 + F.when(right(node), 1).otherwise(0))


def fixed(x: Column) -> Column:
    return F.floor(x * F.lit(float(UNIT)) + F.lit(0.5)).cast("long")


def exp(x: np.ndarray) -> np.ndarray:
    """By the C library, whose last bit other engines have; rows of one leaf share their score."""
    at, few = pd.factorize(x)
    return np.array([math.exp(v) for v in few.tolist()])[at] if len(few) else x


def slopes(loss: str, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian in whole parts of UNIT."""
    if loss == "tweedie":
        a, b = exp(0.5 * score), exp(-0.5 * score)
        g, h = a - y * b, 0.5 * a + 0.5 * y * b
    elif loss == "log":
        g, h = score - y, np.ones(len(y))
    else:
        e = exp(-score)
        g, h = 1.0 / (1.0 + e) - y, e / ((1.0 + e) * (1.0 + e))
    return tuple(np.floor(x * float(UNIT) + 0.5).astype(np.int64) for x in (g, h))


def _few(models: int, spec: Boosting, features: int) -> bool:
    """Whether the cells of all models fit an array."""
    return 0 < (models << spec.depth) * features * (spec.bins + 1) <= MOST_CELLS


def _binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """bins_of a feature's values, by arrays."""
    return np.where(np.isnan(x), 0, 1 + np.searchsorted(cuts, x, "left"))


def _added(code: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers by code: sums of doubles are exact up to 2^53, larger ones go in two parts."""
    if int(np.abs(x).max(initial=0)) * len(x) < 1 << 53:
        return np.bincount(code, x, size).astype(np.int64)
    low = 1 << 24
    return np.bincount(code, x % low, size).astype(np.int64) + np.bincount(code, x // low, size).astype(np.int64) * low


_BLOCKS = "m int, bins binary, y binary, score binary, cells binary"


class _Blocks:
    """Training rows as blocks: a row of the table holds some thousand rows of one model as arrays, and their cells at the root."""

    def __init__(self, spec: Boosting, models: int, features: int):
        self.spec, self.models, self.features = spec, models, features
        self.kind = np.dtype("u1" if spec.bins < 256 else "<u4")

    def sums(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray | int, nodes: int) -> np.ndarray:
        """Sums of gradients, hessians and rows by node (from 0), feature and bin."""
        width = self.spec.bins + 1
        out = np.zeros((3, nodes, self.features, width), np.int64)
        start = node * width
        for f in range(self.features):
            code = bins[f] + start
            for i, x in enumerate((g, h)):
                out[i, :, f] = _added(code, x, nodes * width).reshape(nodes, width)
            out[2, :, f] = np.bincount(code, minlength=nodes * width).reshape(nodes, width)
        return out

    def block(self, m: int, bins: np.ndarray, y: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        root = self.sums(bins, *slopes(self.spec.loss, y, score), 0, 1)
        columns = [pa.array([x.tobytes()], pa.binary()) for x in (bins, y, score, root)]
        return pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), *columns], names=["m", "bins", "y", "score", "cells"])

    def packed(self, cuts: list[list[np.ndarray]], starts: list[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """From rows (m, y, features) to blocks."""
        most = max(1, min(BLOCK_ROWS, HELD_ROWS // self.models))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            rows: dict[int, int] = {}

            def made(k: int) -> pa.RecordBatch:
                bins, y = (np.concatenate(part, axis=-1) for part in zip(*held.pop(k), strict=True))
                return self.block(k, bins, y, np.full(len(y), starts[k]))

            for batch in batches:
                m, y, *x = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
                for k in np.unique(m).tolist():
                    own = np.flatnonzero(m == k)
                    bins = np.stack([_binned(c[own], cuts[k][f]) for f, c in enumerate(x)]).astype(self.kind)
                    held.setdefault(k, []).append((bins, y[own]))
                    rows[k] = rows.get(k, 0) + len(own)
                    if rows[k] >= most:
                        yield made(k)
                        rows[k] = 0
            for k in list(held):
                yield made(k)

        return run

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """m, bins (a row per feature), y and score of each block."""
        for batch in batches:
            for i in range(batch.num_rows):
                bins, y, score = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("bins", self.kind), ("y", "<f8"), ("score", "<f8")))
                yield batch.column("m")[i].as_py(), bins.reshape(self.features, -1), y, score

    def given(self, sums: np.ndarray, level: int) -> pa.RecordBatch:
        """The cells of a task, each once. sums: by kind, model, node, feature and bin."""
        m, node, f, bin_ = np.nonzero(sums[2])
        columns = [pa.array(x, pa.int32()) for x in (m, node + (1 << level), f, bin_)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(x[m, node, f, bin_]) for x in sums)], names=["_m", "node", "feature", "bin", "g", "h", "n"])

    def root(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (m, cells) the cells of all roots."""
        sums = np.zeros((3, self.models, 1, self.features, self.spec.bins + 1), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                sums[:, batch.column("m")[i].as_py()] += np.frombuffer(batch.column("cells")[i].as_buffer(), np.int64).reshape(3, 1, self.features, -1)
        yield self.given(sums, 0)


class _Forest:
    """One tree of each of a few models as arrays, for tasks that read blocks."""

    def __init__(self, heaps: Sequence[_Heap], blocks: _Blocks):
        self.blocks, self.spec = blocks, blocks.spec
        self.feature, self.cut = (np.array([[-1 if x is None else x for x in getattr(h, c)] for h in heaps], np.int64) for c in ("feature", "cut"))
        self.leaf = np.array([h.leaves(blocks.spec) for h in heaps])

    def node(self, m: int, bins: np.ndarray, levels: int) -> np.ndarray:
        return _walked(self.feature[m], self.cut[m], bins, levels)

    def cells(self, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Sums of gradients, hessians and rows by model, node, feature and bin: a task gives each of its cells once."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, len(self.leaf), 1 << level, self.blocks.features, self.spec.bins + 1), np.int64)
            for m, bins, y, score in self.blocks.read(batches):
                sums[:, m] += self.blocks.sums(bins, *slopes(self.spec.loss, y, score), self.node(m, bins, level) - (1 << level), 1 << level)
            yield self.blocks.given(sums, level)

        return run

    def moved(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks with their leaves added."""
        for m, bins, y, score in self.blocks.read(batches):
            yield self.blocks.block(m, bins, y, score + self.leaf[m][self.node(m, bins, self.spec.depth) - (1 << self.spec.depth)])


def _walked(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
    """The node that bins (a row per feature) lead to after so many levels of one tree."""
    node, row = np.ones(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for _ in range(levels):
        f = feature[node]
        node = 2 * node + ((f >= 0) & (bins[f, row] > cut[node]))
    return node


class CutSearch:
    """Finds the best cut of every node; its columns are built once and serve all levels and rounds."""

    def __init__(self, by: Sequence[str], spec: Boosting):
        self.keys = [*by, "node"]
        along = Window.partitionBy(*self.keys, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*self.keys, "feature")
        self.sums = {f"_l{c}": F.sum(c).over(along) for c in "ghn"} | {f"_a{c}": F.sum(c).over(whole) for c in "ghn"}
        unit = lambda c: F.col(c).cast("double") / F.lit(float(UNIT))
        part = lambda g, h: g * g / (h + F.lit(spec.shrink))
        left, right = (unit("_lg"), unit("_lh")), (unit("_ag") - unit("_lg"), unit("_ah") - unit("_lh"))
        gain = part(*left) + part(*right) - part(unit("_ag"), unit("_ah"))
        good = (F.col("_ln") >= spec.least_rows) & (F.col("_an") - F.col("_ln") >= spec.least_rows) & (gain > spec.least_gain)
        # equal gains: the first feature, then the lowest cut
        choice = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.col("_lg").alias("lg"), F.col("_lh").alias("lh"))
        self.best = [F.max("_ag").alias("g"), F.max("_ah").alias("h"), F.max(F.when(good, choice)).alias("c")]
        self.out = [*map(F.col, self.keys), F.col("g"), F.col("h"), (-F.col("c.f")).alias("feature"), (-F.col("c.b")).alias("cut"), F.col("c.lg").alias("lg"), F.col("c.lh").alias("lh")]

    def __call__(self, cells: DataFrame, parts: bool = False) -> DataFrame:
        """A row per node: its sums g and h and, where a cut gains enough, feature, cut and the sums of its left side. cells: node, feature, bin, g, h, n, in `parts` or once each."""
        # one shuffle serves the running sums and the choice
        cells = cells.repartition(*self.keys)
        if parts:
            cells = cells.groupBy(*self.keys, "feature", "bin").agg(*(F.sum(c).alias(c) for c in "ghn"))
        return cells.withColumns(self.sums).groupBy(*self.keys).agg(*self.best).select(*self.out)


class _Heap:
    """A tree that is growing: cuts of inner nodes and sums of all nodes."""

    def __init__(self, depth: int):
        self.depth = depth
        self.feature: list[int | None] = [None] * (1 << depth)
        self.cut: list[int | None] = [None] * (1 << depth)
        self.sums: list[tuple[int, int]] = [(0, 0)] * (2 << depth)

    def grow(self, row) -> None:
        n, whole = row.node, (row.g, row.h)
        self.sums[n] = whole
        if row.feature is None:
            self.sums[2 * n] = whole  # all rows go left
        else:
            self.feature[n], self.cut[n] = row.feature, row.cut
            self.sums[2 * n], self.sums[2 * n + 1] = (row.lg, row.lh), (row.g - row.lg, row.h - row.lh)

    def leaves(self, spec: Boosting) -> list[float]:
        value = lambda g, h: -spec.rate * (g / UNIT) / (h / UNIT + spec.shrink)
        return [value(*s) for s in self.sums[1 << self.depth :]]


@dataclass
class Model:
    """Fitted models: table (by, start, cuts, trees), a row per model."""

    spec: Boosting
    by: list[str]
    features: list[str]
    table: DataFrame
    models: int

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, spec: Boosting, by: Sequence[str], features: Sequence[str]) -> Model:
        table = spark.read.parquet(path)
        return cls(spec, list(by), list(features), table, table.count())

    def score(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        """`rows` with the prediction of the model of their key, null where there is none."""
        tables = ("start", "cuts", "trees", "bins")
        clash = [c for c in rows.columns if c in tables]
        if clash:
            raise ValueError(f"columns {', '.join(clash)} must have other names")
        if _few(self.models, self.spec, len(self.features)):
            return self._score_few(rows, name)
        known = _attached(rows, self.table, self.by, self.models, "left").withColumn("bins", bins_of(self.features))
        right = lambda t, node: F.coalesce(F.get("bins", F.get(t["feature"], node)) > F.get(t["cut"], node), F.lit(False))
        leaf = lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(self.spec.depth)), F.lit(1), lambda node, _: node * 2 + F.when(right(t, node), 1).otherwise(0))
        total = F.aggregate("trees", F.col("start"), lambda acc, t: acc + F.get(t["leaf"], leaf(t) - (1 << self.spec.depth)))
        return known.withColumn(name, _LOSSES[self.spec.loss][4](total)).drop(*tables)

    def _score_few(self, rows: DataFrame, name: str) -> DataFrame:
        """The same where all models fit a task: only a row's features and the number of its model go to it."""
        known = self.table.collect()
        of = StructType([*(self.table.schema[c] for c in self.by), StructField("_m", IntegerType())])
        numbers = _local(rows.sparkSession, [(*(r[c] for c in self.by), i) for i, r in enumerate(known)], of)
        cuts = [[np.array(c, np.float64) for c in r.cuts] for r in known]
        starts = [r.start for r in known]
        whole = lambda heap: np.array([-1 if x is None else x for x in heap], np.int64)
        trees = [[(whole(t.feature), whole(t.cut), np.array(t.leaf)) for t in r.trees] for r in known]
        depth = self.spec.depth

        @F.pandas_udf("double")
        def total(m: pd.Series, *x: pd.Series) -> pd.Series:
            out, number = np.full(len(m), np.nan), m.to_numpy()
            for k in np.unique(number[number >= 0]).tolist():
                own = np.flatnonzero(number == k)
                bins = np.stack([_binned(c.to_numpy(np.float64, na_value=np.nan)[own], cuts[k][f]) for f, c in enumerate(x)])
                score = np.full(len(own), starts[k])
                for feature, cut, leaf in trees[k]:
                    score = score + leaf[_walked(feature, cut, bins, depth) - (1 << depth)]
                out[own] = score
            return pd.Series(out)

        said = total(F.coalesce("_m", F.lit(-1)), *(F.col(c).cast("double") for c in self.features))
        marked = _attached(rows, numbers, self.by, self.models, "left").withColumn(name, said)
        return marked.withColumn(name, F.when(F.col("_m").isNotNull(), _LOSSES[self.spec.loss][4](F.col(name)))).drop("_m")


def fit(rows: DataFrame, by: Sequence[str], features: Sequence[str], label: str, spec: Boosting = Boosting()) -> Model:
    """A model per value of `by`, from the rows with that value."""
    spark, by, features = rows.sparkSession, list(by), list(features)
    start, target, gradient, hessian, _ = _LOSSES[spec.loss]
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, label]])
    rows = written(rows.where(usable).select(*by, *(F.col(c).cast("double").alias(c) for c in features), target(F.col(label).cast("double")).alias("_y")), "boosting")
    mean = F.avg("_y")
    if spec.loss != "log":
        mean = F.greatest(mean, F.lit(LEAST_MEAN))
    if spec.loss == "logistic":
        mean = F.least(mean, F.lit(1 - LEAST_MEAN))
    starts = written(rows.groupBy(*by).agg(F.round(start(mean), 9).alias("start")), "starts")
    models = starts.count()
    if _few(models, spec, len(features)):
        return _fit_few(rows, starts, by, features, spec, models)
    base = written(starts.join(_keyed(cut_points(rows, by, features, spec.bins), by), _on(by)).select(*by, "start", "cuts"), "models")
    dropped(starts)
    state = written(_attached(rows, base, by, models).select(*by, F.col("_y").alias("y"), bins_of(features).alias("bins"), F.col("start").alias("score")), "boosted")
    dropped(rows)
    keys = StructType([base.schema[c] for c in by])
    trees: dict[tuple, list[_Heap]] = {tuple(r[c] for c in by): [] for r in base.select(*by).collect()}

    def sent(heaps: dict[tuple, _Heap], leaves: bool) -> DataFrame:
        data = [(*k, h.feature, h.cut, h.leaves(spec) if leaves else []) for k, h in heaps.items()]
        return _local(spark, data, StructType([*keys.fields, *_TREE.fields]))

    search = CutSearch(by, spec)
    g, h = (fixed(f(F.col("y"), F.col("score"))).alias(name) for f, name in ((gradient, "g"), (hessian, "h")))
    nodes = [walk(level).alias("node") for level in range(spec.depth)]
    cell, totals = [*by, "node", "feature", "bin"], [F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")]
    spread = [*by, "node", "g", "h", F.posexplode("bins").alias("feature", "bin")]
    moved = [*by, "y", "bins", (F.col("score") + F.get("leaf", walk(spec.depth) - (1 << spec.depth))).alias("score")]
    for _ in range(spec.rounds if trees else 0):
        heaps = {k: _Heap(spec.depth) for k in trees}
        for level in range(spec.depth):
            at = state if level == 0 else _attached(state, sent(heaps, False), by, models)
            cells = at.select(*by, nodes[level], g, h, "bins").select(*spread).groupBy(*cell).agg(*totals)
            for row in search(cells).collect():  # a row per node
                heaps[tuple(row[c] for c in by)].grow(row)
        for k, heap in heaps.items():
            trees[k].append(heap)
        after = written(_attached(state, sent(heaps, True), by, models).select(*moved), "boosted")
        dropped(state)
        state = after
    forest = [(*k, [{"feature": t.feature, "cut": t.cut, "leaf": t.leaves(spec)} for t in own]) for k, own in trees.items()]
    known = _local(spark, forest, StructType([*keys.fields, StructField("trees", ArrayType(_TREE))]))
    table = written(_attached(base.drop("_m"), known, by, models), "models")
    dropped(state)
    return Model(spec, by, features, table, models)


def _fit_few(rows: DataFrame, starts: DataFrame, by: list[str], features: list[str], spec: Boosting, models: int) -> Model:
    """The same trees where the cells of all models fit an array: a task reads its rows in blocks and gives sums."""
    spark = rows.sparkSession
    known = starts.collect()
    keys = [tuple(r[c] for c in by) for r in known]
    of = [starts.schema[c] for c in by]
    numbers = _local(spark, [(*k, i) for i, k in enumerate(keys)], StructType([*of, StructField("_m", IntegerType())]))
    cuts = few_cuts(_attached(rows, numbers, by, models), models, features, spec.bins)
    blocks = _Blocks(spec, models, len(features))
    doubles = _attached(rows, numbers, by, models).select("_m", "_y", *features)
    small = {"parquet.block.size": 8 << 20}  # a task holds a row group's blocks
    state = written(doubles.mapInArrow(blocks.packed(cuts, [r.start for r in known]), _BLOCKS), "boosted", **small)
    dropped(rows)
    search = CutSearch(["_m"], spec)
    found = "_m int, node int, feature int, bin int, g long, h long, n long"
    trees: list[list[_Heap]] = [[] for _ in keys]
    for step in range(spec.rounds):
        heaps = [_Heap(spec.depth) for _ in keys]
        for level in range(spec.depth):
            at = state.drop("cells").mapInArrow(_Forest(heaps, blocks).cells(level), found) if level else state.select("m", "cells").mapInArrow(blocks.root, found)
            for row in search(at, parts=True).collect():  # a row per node
                heaps[row["_m"]].grow(row)
        for own, heap in zip(trees, heaps, strict=True):
            own.append(heap)
        if step + 1 < spec.rounds:
            after = written(state.drop("cells").mapInArrow(_Forest(heaps, blocks).moved, _BLOCKS), "boosted", **small)
            dropped(state)
            state = after
    forest = [(*k, r.start, [c.tolist() for c in own], [{"feature": t.feature, "cut": t.cut, "leaf": t.leaves(spec)} for t in grown]) for k, r, own, grown in zip(keys, known, cuts, trees, strict=True)]
    table = written(_local(spark, forest, StructType([*of, StructField("start", DoubleType()), StructField("cuts", ArrayType(ArrayType(DoubleType()))), StructField("trees", ArrayType(_TREE))])), "models")
    dropped(starts)
    dropped(state)
    return Model(spec, by, features, table, models)


def mean_loss(spec: Boosting, label: str, prediction: str) -> Column:
    """The mean of the loss that `spec` lowers, as an aggregate."""
    y, p = F.col(label).cast("double"), F.col(prediction)
    if spec.loss == "tweedie":
        return F.avg(F.lit(2.0) * y / F.sqrt(p) + F.lit(2.0) * F.sqrt(p))
    if spec.loss == "log":
        return F.avg(F.pow(F.log1p(y) - F.log1p(p), 2))
    return F.avg(-y * F.log(p) - (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))
