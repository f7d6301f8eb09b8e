"""The same semantics on streams: windows, sessions, deduplication and a live pool of servers."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of parquet files with their event time as a timestamp."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return _counted(events.withWatermark("ts", late), F.window("ts", width))


def sliding(events: DataFrame, width: str = "24 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return _counted(events.withWatermark("ts", late), F.window("ts", width, step))


def _counted(events: DataFrame, window) -> DataFrame:
    rows = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def live_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: list[str], late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def live_waits(events: DataFrame, k: int, scale: float = 1000.0) -> DataFrame:
    """(user_id, event_id, wait_us) of each user's own pool of k servers, first come, first served.

    The state of a user is when each server becomes free, and the last rank
    seen; a batch brings a user's jobs in any order, and a job that comes after
    a later one was placed is set aside with a null wait.
    """
    rows = events.select("user_id", "event_id", F.unix_micros("ts").alias("at"), F.bround(F.col("value") * 1e6).cast("long").alias("cost"))

    def place(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free, last = (list(state.get[0]), tuple(state.get[1])) if state.exists else ([-(1 << 62)] * k, (-(1 << 62), -1))
        heapq.heapify(free)
        pdf = pd.concat(list(batches)).sort_values(["at", "event_id"])
        waits: list[int | None] = []
        for at, job, cost in zip(pdf["at"], pdf["event_id"], pdf["cost"], strict=True):
            if (at, job) < last:
                waits.append(None)
                continue
            begin = max(free[0], at)
            heapq.heapreplace(free, int(begin + cost * scale))
            waits.append(int(begin - at))
            last = (int(at), int(job))
        state.update((sorted(free), list(last)))
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"].to_numpy(), "wait_us": pd.array(waits, dtype="Int64")})

    return rows.groupBy("user_id").applyInPandasWithState(place, "user_id long, event_id long, wait_us long", "free array<long>, last array<long>", "append", GroupStateTimeout.NoTimeout)


#: Groups that the keys of live histories are dealt to by a hash; each is one state.
BUCKETS = 256


def live_history(jobs: DataFrame, by: str, late: str = "2 hours") -> DataFrame:
    """(job_id, n, work_us, errors): the results of its key that each job could read when it arrived.

    `jobs` has the key, job_id, ts (arrival, event time), arrival_us,
    available_us, work_us and is_error. A job waits until the watermark has
    passed its arrival, so rows may come in any order within `late`; a timer on
    its bucket's earliest waiting job then fires, and results and jobs behind
    the watermark are read off in order. A state holds the sums of a bucket's
    keys, and the jobs and results that the watermark has not passed. A bucket
    is sorted and summed as a whole, so that a batch costs a call a bucket and
    not one a key; its numbers are kept as bytes, which pass between Spark and
    Python without a step a number. A row behind the watermark is dropped.
    """
    # sums: n, work, errors by key. held: key, at, kind, job, cost, error by row
    schema = "names array<string>, sums binary, held binary"

    def read(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, *known = state.get if state.exists else ([], b"", b"")
        sums, held = (np.frombuffer(x, dtype="int64").reshape(n, len(x) // (8 * n)).copy() for x, n in zip(known, (3, 6), strict=True))
        passed = state.getCurrentWatermarkMs() * 1000
        come = list(batches)  # none when a timer fires
        if come:
            pdf = pd.concat(come)
            codes, names = pd.factorize(np.array([*names, *pdf["name"]], dtype=object), use_na_sentinel=False)
            key = codes[sums.shape[1] :]
            sums = np.pad(sums, ((0, 0), (0, len(names) - sums.shape[1])))
            arrival, available, job, cost, error = (pdf[c].to_numpy("int64") for c in ("arrival_us", "available_us", "job_id", "work_us", "is_error"))
            held = np.hstack([held, [key, available, np.where(available == arrival, 3, 0), job, cost, error], [key, arrival, np.ones_like(job), job, cost, error]])
        held = held[:, np.lexsort(held[3::-1])]
        key, at, kind, job, cost, error = held
        result = kind != 1
        upto = np.cumsum(np.where(result, [np.ones_like(cost), cost, error], 0), axis=1)
        # where a key begins, what comes before is not its own
        start = np.searchsorted(key, key, "left")
        total = upto - np.where(start > 0, upto[:, start - 1], 0) + sums[:, key]
        past = at < passed
        due = past & ~result
        out = pd.DataFrame({"job_id": job[due], "n": total[0, due], "work_us": total[1, due], "errors": total[2, due]})
        done = past & result
        for line, x in zip(sums, (np.ones_like(cost), cost, error), strict=True):
            np.add.at(line, key[done], x[done])
        held = held[:, ~past]
        state.update((list(names), sums.tobytes(), held.tobytes()))
        waiting = held[1, held[2] == 1]
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting.min()) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield out

    rows = jobs.withWatermark("ts", late).select(F.pmod(F.xxhash64(by), F.lit(BUCKETS)).alias("bucket"), F.col(by).cast("string").alias("name"), "ts", "job_id", "arrival_us", "available_us", "work_us", "is_error")
    return rows.groupBy("bucket").applyInPandasWithState(read, "job_id long, n long, work_us long, errors long", schema, "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it gave, from Parquet files under `folder`.

    A batch writes a folder of its own, anew if it is tried again. In complete
    mode each batch holds all results, so the last one counts.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch:09d}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch=*")
    if mode == "complete":
        out = out.where(F.col("batch") == (out.agg(F.max("batch")).first()[0] or 0))
    return out.drop("batch")
