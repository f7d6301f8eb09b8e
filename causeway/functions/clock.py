"""The jobs view of an event table, and the clock: arrivals, availability, calendar."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns

SECOND = 1_000_000
HOUR, DAY, WEEK = 3_600 * SECOND, 86_400 * SECOND, 7 * 86_400 * SECOND
#: No job works longer than this.
LIMIT = 60 * SECOND
#: 1970-01-05, the first Monday.
MONDAY = 4 * DAY


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def seconds_to_micros(seconds: Column) -> Column:
    """Half to even, so that no rounding favours longer times."""
    return F.bround(seconds * F.lit(1e6), 0).cast("long")


def executed(cost: Column, limit: int = LIMIT) -> Column:
    return F.least(cost, F.lit(limit))


def jobs(events: DataFrame) -> DataFrame:
    """One row per event as a job of a queue.

    job_id, user_key, item_key, kind, header_us, cost_us, is_error,
    is_result_only (a record that takes no work), week, class_term,
    assessment, deadline_us.
    """
    require_columns(events, ("event_id", "ts", "user_id", "event_type", "value", "props"))
    header = micros(F.col("ts"))
    week = F.floor((F.col("header_us") - MONDAY) / WEEK).cast("long")
    base = events.select(
        F.col("event_id").alias("job_id"),
        F.col("user_id").alias("user_key"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("item_key"),
        F.col("event_type").alias("kind"),
        header.alias("header_us"),
        seconds_to_micros(F.col("value")).alias("cost_us"),
        (F.col("event_type") == "error").cast("int").alias("is_error"),
        (F.col("event_type") == "view").alias("is_result_only"),
    ).withColumn("week", week)
    return base.withColumns(
        {
            "class_term": composite("week", F.col("user_key") % 8),
            "assessment": composite("week", F.col("item_key") % 10),
            "deadline_us": (F.col("week") + 1) * WEEK + MONDAY,
        }
    )


def composite(*parts: Column | str) -> Column:
    return F.concat_ws("|", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))


def arrival_and_availability(
    jobs_: DataFrame, reading: str = "submit", delta: int = 0, result_lag: int = 60 * SECOND, limit: int = LIMIT
) -> DataFrame:
    """`jobs_` with arrival_us and available_us.

    The header is the moment of submission, or of the result, from which the
    work is then taken back. A result is readable `delta` after the work is
    done; a record without work is readable `result_lag` after its arrival.
    """
    if reading not in ("submit", "result"):
        raise ValueError("reading must be submit or result")
    work = F.when(F.col("is_result_only"), F.lit(0)).otherwise(executed(F.col("cost_us"), limit))
    arrival = F.col("header_us") - (work if reading == "result" else F.lit(0))
    return jobs_.withColumn("work_us", work.cast("long")).withColumn("arrival_us", arrival.cast("long")).withColumn(
        "available_us", (F.col("arrival_us") + F.col("work_us") + F.lit(delta) + F.when(F.col("is_result_only"), F.lit(result_lag)).otherwise(F.lit(0))).cast("long")
    )


def keyed_bits(*keys: Column) -> Column:
    """52 bits of a digest of the keys, as any engine with md5 can repeat them."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in keys))), 1, 13), 16, 10).cast("long")


def jitter(*keys: str) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return keyed_bits(*(F.col(k) for k in keys)) * F.lit(2.0**-52)


def power(base: Column, exponent: float) -> Column:
    """`base` to `exponent` by the C library, as other engines take it: the JVM's last bit may differ, which shows where the result is cut to whole numbers."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or math.isnan(x) else math.pow(x, exponent) for x in values.tolist()], dtype="float64")

    return run(base)


def calendar(arrival: Column, deadline: Column) -> dict[str, Column]:
    """Hour, day of the week (Monday 0), and whole seconds to the deadline."""
    return {
        "hour": (F.floor(F.pmod(arrival, F.lit(DAY)) / HOUR)).cast("int"),
        "weekday": F.pmod(F.floor(arrival / DAY) + 3, F.lit(7)).cast("int"),
        "to_deadline_s": F.floor((deadline - arrival) / SECOND).cast("long"),
    }


def in_deadline_window(arrival: Column, deadline: Column, window: int = DAY) -> Column:
    return (deadline - arrival).between(0, window)
