"""The whole feature block of a submission: its exercise, its user, the pair, and what relates them.

All of it is read off one merged stream of results, reads and registrations
that is sorted per key. Running sums are windows. Keys that contain the user
share a shuffle by user. An exercise's rows are sorted once: its sums are
windows over that order, and those of its classes, assessments and terciles of
users are carried along it in one pass (see carried), since a sort a key would
hold all rows of an exercise as often. What an assessment holds is read off
narrow rows. Order statistics of the last results come from a pass over the
sorted stream (see sliding).

Costs enter as whole millionths of log(1 + seconds), so that sums are exact in
any order. Statistics without a result are null, counts are 0, and a user
without results is of the middle tercile. Results of records that aren't
submissions only show in the user's last result, and their arrival in the time
since the user's last one.

A permuted twin of every read looks relations up at another exercise and
assessment, as a negative control; what is written keeps its own keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from .history import is_result
from .sliding import sliding
from .traces import starts

UNIT = 1_000_000


def log_cost(work_us: Column) -> Column:
    """log(1 + seconds) in whole millionths."""
    return F.floor(F.log1p(work_us / F.lit(1e6)) * UNIT + F.lit(0.5)).cast("long")


def _stream(jobs: DataFrame, other_item: Column, other_assessment: Column) -> DataFrame:
    """Results (0, or 3 if readable on arrival), reads (1), their permuted twins (1), registrations (2)."""
    carry = ["user_key", "item_key", "assessment", "class_term", "arrival_us", "is_error", "heavy", "tests", "is_submission", "cost"]
    rows = jobs.withColumn("cost", log_cost(F.col("work_us")))
    zero = F.when(F.col("available_us") == F.col("arrival_us"), 3).otherwise(0)
    leg = lambda df, at, kind, twin: df.select(F.col(at).alias("at_us"), kind.alias("kind"), F.lit(twin).alias("twin"), "job_id", *carry)
    reads = rows.where("is_submission")
    twins = reads.withColumns({"item_key": other_item, "assessment": other_assessment})
    return (
        leg(rows, "available_us", zero, 0)
        .unionByName(leg(reads, "arrival_us", F.lit(1), 0))
        .unionByName(leg(twins, "arrival_us", F.lit(1), 1))
        .unionByName(leg(rows, "arrival_us", F.lit(2), 0))
    )


def _over(*by: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("at_us", "kind", "twin", "job_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _sums(prefix: str, over: WindowSpec, *what: str) -> dict[str, Column]:
    """Running sums of submissions' results: n, and of `what`."""
    counted = is_result() & F.col("is_submission")
    out = {f"{prefix}_n": F.count(F.when(counted, 1)).over(over)}
    for c in what:
        x = F.col("cost").cast("decimal(38,0)") * F.col("cost") if c == "square" else F.col(c)
        out[f"{prefix}_{c}"] = F.coalesce(F.sum(F.when(counted, x.cast("decimal(38,0)") if c == "square" else x)).over(over), F.lit(0))
    return out


def _mean(prefix: str, c: str, unit: float = 1.0) -> Column:
    n = F.col(f"{prefix}_n")
    out = F.when(n > 0, F.col(f"{prefix}_{c}").cast("double") / n)
    return out / F.lit(unit) if unit != 1.0 else out


def _deviation(prefix: str) -> Column:
    mean = F.col(f"{prefix}_cost").cast("double") / F.col(f"{prefix}_n")
    return F.when(F.col(f"{prefix}_n") > 0, F.sqrt(F.greatest(F.col(f"{prefix}_square").cast("double") / F.col(f"{prefix}_n") - mean * mean, F.lit(0.0))) / F.lit(float(UNIT)))


def _since(last_us: Column) -> Column:
    return F.log1p((F.col("at_us") - last_us) / F.lit(1e6))


def carried(rows: DataFrame, by: str, families: Mapping[str, tuple[str, Sequence[str]]], keep: Sequence[str]) -> DataFrame:
    """`keep` of the reads, and `<family>_n` and `<family>_<column>`: sums over the rows that count, of their `by` and the family's own key, up to each.

    `rows` are sorted by `by` and time within partitions, and have `reads` and
    `counts` (booleans); families: {family: (key, columns of whole numbers)}. A
    task holds a batch, and the sums of each key that one `by` has.
    """
    keep = list(keep)
    names = [f"{f}_{c}" for f, (_, columns) in families.items() for c in ("n", *columns)]
    schema = StructType([*(rows.schema[c] for c in keep), *(StructField(n, LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []  # the `by` that the batch before ended in
        known: dict[str, dict] = {f: {} for f in families}
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = starts(batch, [by])
            trace = np.zeros(batch.num_rows, dtype="int64")
            trace[cuts[1:]] = 1
            trace = np.cumsum(trace)
            if last != [batch.column(by)[0].as_py()]:
                known = {f: {} for f in families}
            last = [batch.column(by)[-1].as_py()]
            counts = batch.column("counts").to_numpy(zero_copy_only=False).astype("int64")
            reads = batch.column("reads")
            out = []
            for f, (key, columns) in families.items():
                codes = pc.dictionary_encode(batch.column(key), null_encoding="encode")
                values, n = codes.dictionary.to_pylist(), len(codes.dictionary)
                of = trace * n + codes.indices.to_numpy()
                order = np.argsort(of, kind="stable")
                at = of[order]
                x = np.stack([counts, *(np.where(counts == 1, batch.column(c).to_numpy(zero_copy_only=False), 0).astype("int64") for c in columns)])[:, order]
                upto = np.cumsum(x, axis=1)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                before = upto[:, first] - x[:, first]
                for i, group in enumerate(at[first]):  # the first trace goes on from the batch before
                    if group >= n:
                        break
                    before[:, i] -= known[f].get(values[group], 0)
                total = upto - np.repeat(before, np.diff(np.r_[first, len(at)]), axis=1)
                ends = np.r_[first[1:], len(at)] - 1
                fresh = {values[group % n]: total[:, e] for group, e in zip(at[ends], ends, strict=True) if group >= trace[-1] * n}
                known[f] = known[f] | fresh if trace[-1] == 0 else fresh
                placed = np.empty_like(total)
                placed[:, order] = total
                out += [pa.array(line).filter(reads) for line in placed]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(reads) for c in keep), *out], schema=pa.schema([*(pa.field(c, batch.schema.field(c).type) for c in keep), *(pa.field(n, pa.int64()) for n in names)]))

    return rows.mapInArrow(run, schema)


def feature_block(jobs: DataFrame, low: float, high: float, other_item: Column, other_assessment: Column) -> DataFrame:
    """A row per submission: 22 columns of history, 5 of relations and 5 of their permuted control.

    `jobs` has job_id, user_key, item_key, assessment, class_term, arrival_us,
    available_us, work_us, is_error, tests (numbers), heavy (0 or 1) and is_submission.
    `low` and `high` cut users into terciles by their mean log cost.
    """
    stream = _stream(jobs, other_item, other_assessment)
    submits = (F.col("kind") == 2) & F.col("is_submission")
    user = _over("user_key")
    latest = F.struct("arrival_us", "job_id", "is_error")
    rows = stream.withColumns(
        {
            **_sums("u", user, "cost", "square", "is_error", "heavy"),
            "u_arrived": F.count(F.when(submits, 1)).over(user),
            "u_last_us": F.max(F.when(F.col("kind") == 2, F.col("at_us"))).over(user),
            "u_last": F.max(F.when(is_result(), latest)).over(user),
        }
    )
    mean = _mean("u", "cost", float(UNIT))
    rows = rows.withColumn("tercile", F.when(mean.isNull(), 1).when(mean < low, 0).when(mean < high, 1).otherwise(2))
    pair = _over("user_key", "item_key")
    shown = F.struct("arrival_us", "job_id", "cost", "is_error")
    rows = rows.withColumns(
        {
            "p_arrived": F.count(F.when(submits, 1)).over(pair),
            "p_last_us": F.max(F.when(submits, F.col("at_us"))).over(pair),
            "p_last": F.max(F.when(is_result() & F.col("is_submission"), shown)).over(pair),
        }
    )
    history = {
        "u_n": F.col("u_arrived"), "u_mean": mean, "u_sd": _deviation("u"), "u_err": _mean("u", "is_error"), "u_heavy": _mean("u", "heavy"),
        "pair_n": F.col("p_arrived"), "pair_last_log": F.col("p_last.cost") / F.lit(float(UNIT)), "pair_last_err": F.col("p_last.is_error"),
        "pair_since": _since(F.col("p_last_us")), "prev_err": F.col("u_last.is_error"), "prev_since": _since(F.col("u_last_us")),
    }
    # what a user's own stream gives is needed by own reads alone
    read = (F.col("kind") == 1) & (F.col("twin") == 0)
    carry = ["item_key", "at_us", "kind", "twin", "job_id", "tercile", "class_term", "assessment", "cost", "is_error", "heavy", "tests", "is_submission"]
    rows = rows.select(*carry, F.when(read, F.struct(*(x.alias(n) for n, x in history.items()))).alias("own"))
    item = _over("item_key")
    rows = rows.repartition("item_key").withColumns({**_sums("e", item, "cost", "square", "is_error", "heavy", "tests"), "e_arrived": F.count(F.when(submits, 1)).over(item)})
    exercise = {
        "ex_n": F.col("e_arrived"), "ex_mean": _mean("e", "cost", float(UNIT)), "ex_sd": _deviation("e"), "ex_err": _mean("e", "is_error"),
        "ex_heavy": _mean("e", "heavy"), "ex_tests": _mean("e", "tests"),
    }
    whole = lambda c: F.col(c).cast("long").alias(c)
    order = ["item_key", "at_us", "kind", "twin", "job_id"]
    rows = rows.select(
        *order, "tercile", "class_term", "assessment", whole("cost"), whole("heavy"), (F.col("kind") == 1).alias("reads"), (is_result() & F.col("is_submission")).alias("counts"), "own",
        F.when(read, F.struct(*(x.alias(n) for n, x in exercise.items()))).alias("exercise"),
    ).where("reads or counts").sortWithinPartitions(*order)
    rows = carried(rows, "item_key", {"t": ("tercile", ["cost", "heavy"]), "c": ("class_term", ["cost"]), "b": ("assessment", ["cost", "heavy"])}, ["job_id", "twin", "own", "exercise"])
    held = {
        "alike_log": _mean("t", "cost", float(UNIT)), "alike_heavy": _mean("t", "heavy"), "class_log": _mean("c", "cost", float(UNIT)),
        "b_n": F.col("b_n"), "b_cost": F.col("b_cost"), "b_heavy": F.col("b_heavy"),
    }
    rows = rows.select("job_id", "twin", "exercise.*", "own.*", *(x.alias(f"_{n}") for n, x in held.items()))
    sums = stream.where("kind <> 2").select("assessment", "at_us", "kind", "twin", "job_id", "is_submission", "cost", "heavy").withColumns(_sums("_a", _over("assessment"), "cost", "heavy"))
    rows = rows.unionByName(sums.where("kind = 1").select("job_id", "twin", "_a_n", "_a_cost", "_a_heavy"), allowMissingColumns=True)
    # two reads a job, each of an exercise and an assessment: one row
    of = lambda twin, c: F.max(F.when(F.col("twin") == twin, F.col(f"_{c}")))
    sides = ((0, ""), (1, "permuted_"))
    out = rows.groupBy("job_id").agg(
        *(F.max(c).alias(c) for c in (*exercise, *history)), *(of(twin, c).alias(f"{side}{c}") for twin, side in sides for c in (*held, "a_n", "a_cost", "a_heavy"))
    )

    def other(side: str, c: str, unit: float) -> Column:
        rest = F.col(f"{side}a_n") - F.col(f"{side}b_n")
        return F.when(rest > 0, (F.col(f"{side}a_{c}") - F.col(f"{side}b_{c}")).cast("double") / rest / F.lit(unit))

    relations = lambda side: (
        f"{side}alike_log", f"{side}alike_heavy", other(side, "cost", float(UNIT)).alias(f"{side}other_log"), other(side, "heavy", 1.0).alias(f"{side}other_heavy"), f"{side}class_log"
    )
    out = out.select("job_id", *exercise, *history, *relations(""), *relations("permuted_"))
    plain = stream.where((F.col("twin") == 0) & F.col("is_submission"))
    for prefix, key, tops in (("ex", "item_key", True), ("u", "user_key", False)):
        recent = sliding(plain, [key], "cost")
        scaled = [(F.col(c) / F.lit(float(UNIT))).alias(f"{prefix}_{n}") for c, n in (("p50", "p50"), ("p90", "p90"), *([("top", "max")] if tops else []))]
        out = out.join(recent.select(F.col("job_id").alias("_j"), *scaled), F.col("job_id") == F.col("_j")).drop("_j")
    return out
