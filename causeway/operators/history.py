"""Causal features: what could be known about a job when it arrived.

Results enter at their availability, jobs read and then register at their
arrival. Everything is put in one stream per key, sorted by (time, kind, job),
and read off with running windows; no job looks at another by a theta join.
Kinds at one instant: 0 a result becomes readable, 1 a job reads, 2 a job
registers, 3 a result that is readable at its own arrival.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .sliding import RECENT, sliding

def merged_stream(jobs: DataFrame, carry: Sequence[str], eligible: Column | None = None, strict: bool = False) -> DataFrame:
    """(at_us, kind, job_id, *carry): three rows per job, or two where its result isn't eligible.

    With `strict` a result that becomes readable at the instant of an arrival
    isn't seen by it.
    """
    result = jobs if eligible is None else jobs.where(eligible)
    zero = F.lit(3) if strict else F.when(F.col("available_us") == F.col("arrival_us"), 3).otherwise(0)
    legs = (
        result.select(F.col("available_us").alias("at_us"), zero.alias("kind"), "job_id", *carry),
        jobs.select(F.col("arrival_us").alias("at_us"), F.lit(1).alias("kind"), "job_id", *carry),
        jobs.select(F.col("arrival_us").alias("at_us"), F.lit(2).alias("kind"), "job_id", *carry),
    )
    return legs[0].unionByName(legs[1]).unionByName(legs[2])


def stream_window(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("at_us", "kind", "job_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def is_result() -> Column:
    return F.col("kind").isin(0, 3)


def of_results(value: Column) -> Column:
    """A value of result rows, null on others."""
    return F.when(is_result(), value)


def read_off(stream: DataFrame, by: Sequence[str], features: Mapping[str, Column]) -> DataFrame:
    """Running aggregates of `stream` per key as they stand when each job reads: (job_id, *features)."""
    over = stream_window(by)
    return stream.withColumns({name: column.over(over) for name, column in features.items()}).where("kind = 1").select("job_id", *features)


def keyed_history(stream: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    """Count, mean work and error share of the readable results of a key; -1 where there is none."""
    sums = read_off(
        stream,
        by,
        {
            "_n": F.count(of_results(F.lit(1))),
            "_w": F.sum(of_results(F.col("work_us"))),
            "_e": F.sum(of_results(F.col("is_error"))),
        },
    )
    mean = lambda c: F.when(F.col("_n") > 0, F.col(c).cast("double") / F.col("_n")).otherwise(F.lit(-1.0))
    return sums.select("job_id", F.col("_n").alias(f"{prefix}_n"), mean("_w").alias(f"{prefix}_mean_us"), mean("_e").alias(f"{prefix}_err"))


def last_result(stream: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of the readable results of a key the one that arrived last, by (arrival, job): not the one done last."""
    value = F.struct("arrival_us", F.col("job_id").alias("j"), "is_error", "work_us")
    rows = read_off(stream, by, {"_last": F.max(of_results(value))})
    return rows.select("job_id", F.col("_last.j").alias("last_job"), F.col("_last.is_error").alias("last_error"), F.col("_last.work_us").alias("last_work_us"))


def registered(stream: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    """Jobs of a key that arrived before, readable or not, and when the last one did."""
    arrived = F.when(F.col("kind") == 2, F.col("at_us"))
    return read_off(stream, by, {f"{prefix}_arrived": F.count(arrived), f"{prefix}_last_us": F.max(arrived)})


def recent_results(jobs: DataFrame, by: Sequence[str], size: int = RECENT, quantiles: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Quantiles and maximum of the last `size` readable results of a key, at each job's arrival."""
    rows = sliding(merged_stream(jobs, [*by, "work_us"]), by, "work_us", quantiles, size)
    names = [f"p{round(100 * p)}" for p in quantiles]
    return rows.select("job_id", "n", *(F.col(c).alias(f"{c}_us") for c in names), F.col("top").alias("max_us"))


def tercile(mean: Column, low: float, high: float) -> Column:
    """0 quick, 1 usual or unknown, 2 slow, against fixed cuts."""
    return F.when(mean < 0, 1).when(mean <= low, 0).when(mean <= high, 1).otherwise(2)


def with_terciles(stream: DataFrame, user: str, low: float, high: float) -> DataFrame:
    """`stream` with the user's tercile: at a result row it includes that result."""
    over = stream_window([user])
    n, w = F.count(of_results(F.lit(1))).over(over), F.sum(of_results(F.col("work_us"))).over(over)
    mean = F.when(n > 0, w.cast("double") / n).otherwise(F.lit(-1.0))
    return stream.withColumn("tercile", tercile(mean, low, high))


def heavy_threshold(jobs: DataFrame, p: float = 0.95) -> DataFrame:
    """One row: the exact quantile of the work of jobs that do any."""
    return jobs.where(~F.col("is_result_only")).agg(F.percentile("work_us", F.lit(p)).alias("heavy_us"))


def duplicates(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`rows` with duplicate: not the first of its key."""
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) > 1)


def coending(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """`rows` with group_size: how many share the key, -1 for those alone."""
    n = F.count("*").over(Window.partitionBy(*key))
    return rows.withColumn("group_size", F.when(n >= 2, n).otherwise(F.lit(-1)))


def merge_coending(rows: DataFrame, key: Sequence[str], order: Sequence[str], work: str, drop: bool = False) -> DataFrame:
    """Of rows that end together the earliest with the largest work, or none of them."""
    group = Window.partitionBy(*key)
    marked = rows.withColumns({"_n": F.count("*").over(group), "_m": F.max(work).over(group), "_i": F.row_number().over(group.orderBy(*order))})
    kept = marked.where("_n = 1") if drop else marked.where("_i = 1")
    return kept.withColumn(work, F.col("_m")).drop("_n", "_m", "_i")


def prefix_lag(rows: DataFrame, by: Sequence[str], order: str, lag: int, value: str) -> DataFrame:
    """Count and sum over rows of a key that are more than `lag` places back."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -(lag + 1))
    return rows.withColumns({"prior_n": F.count("*").over(before), "prior_sum": F.coalesce(F.sum(value).over(before), F.lit(0))})


def distinct_before(rows: DataFrame, by: Sequence[str], order: str, item: str) -> DataFrame:
    """How many different items of a key come before each row."""
    first = F.when(F.row_number().over(Window.partitionBy(*by, item).orderBy(order)) == 1, 1).otherwise(0)
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_first", first).withColumn("distinct_before", F.coalesce(F.sum("_first").over(before), F.lit(0))).drop("_first")


def recent_neighbours(rows: DataFrame, by: Sequence[str], order: Sequence[str], node: str, last: int = 96, most: int = 16) -> DataFrame:
    """The `most` most recent distinct nodes among a key's last rows, latest first."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(-last, -1)
    return rows.withColumn("near", F.slice(F.array_distinct(F.reverse(F.collect_list(node).over(before))), 1, most))


def in_flight(stream: DataFrame, by: Sequence[str]) -> DataFrame:
    """Jobs of a key that arrived but whose results aren't readable yet."""
    started, done = F.count(F.when(F.col("kind") == 2, 1)), F.count(of_results(F.lit(1)))
    return read_off(stream, by, {"_started": started, "_done": done}).select("job_id", (F.col("_started") - F.col("_done")).alias("in_flight"))


#: Rows of a key that are folded in one array.
EWM_BLOCK = 256


def ewm(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.2) -> DataFrame:
    """Exponentially weighted mean of a key's earlier rows, null for its first.

    A step is s -> (1 - alpha) s + alpha v, so a stretch of n rows is s ->
    (1 - alpha)^n s + b. Stretches of EWM_BLOCK rows are folded by themselves,
    then those of a key in order, and each row's mean follows from its
    stretch's start: no array holds more than the stretches of a key.
    """
    place = Window.partitionBy(*by).orderBy(*order)
    numbered = rows.select(*by, *order, F.col(value).cast("double").alias("_v"), F.row_number().over(place).alias("_n"))
    numbered = numbered.withColumn("_block", F.floor((F.col("_n") - 1) / EWM_BLOCK))
    # the first value stands for the mean before it, which makes the first step a plain one
    first = F.when(F.col("_n") == 1, F.col("_v")).otherwise(F.lit(alpha) * F.col("_v"))
    items = F.array_sort(F.collect_list(F.struct("_n", *order, first.alias("_v"))))
    blocks = numbered.groupBy(*by, "_block").agg(items.alias("_items"))
    keep = F.lit(1.0 - alpha)
    inner = F.aggregate("_items", F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(keep * F.element_at(acc, -1) + x["_v"])))
    blocks = blocks.withColumn("_b", inner)
    ends = F.array_sort(F.collect_list(F.struct("_block", F.size("_items").alias("n"), F.element_at("_b", -1).alias("b"))))
    keys = blocks.groupBy(*by).agg(ends.alias("_ends"))
    starts = F.aggregate("_ends", F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.pow(keep, x["n"]) * F.element_at(acc, -1) + x["b"])))
    # stretches are numbered from 0 without gap
    starts = keys.select(*by, F.posexplode(F.slice(starts, F.lit(1), F.size("_ends"))).alias("_at", "_start"))
    names = {c: f"_k{i}" for i, c in enumerate(by)}
    on = [F.col("_block") == F.col("_at"), *(F.col(c).eqNullSafe(F.col(k)) for c, k in names.items())]
    one = blocks.join(starts.withColumnsRenamed(names), on).select(*by, "_start", F.posexplode(F.zip_with("_items", F.slice("_b", F.lit(1), F.size("_items")), lambda x, b: F.struct(x.alias("x"), b.alias("b")))).alias("_i", "_r"))
    mean = F.when(F.col("_r.x._n") > 1, F.pow(keep, F.col("_i")) * F.col("_start") + F.col("_r.b"))
    return one.select(*by, *(F.col(f"_r.x.{c}").alias(c) for c in order), mean.alias("ewm"))
