"""Traces as a sorted stream, and quantiles without a group in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from causeway.operators import metrics, replay
from causeway.operators.traces import per_trace


def test_traces_across_batches(spark):
    n = 25_000  # more than a batch of Arrow
    rows = spark.range(n).select((F.when(F.col("id") >= 60, F.when(F.col("id") < 22_000, 7).otherwise(F.col("id") % 900 + 8))).cast("long").alias("k"), "id", (F.col("id") % 13).alias("v"))
    got = per_trace(rows.repartition(5), ["k"], ["id"], ["k", "id"], lambda x: [np.cumsum(x["v"]), np.full(len(x["v"]), len(x["v"]))], "run long, size long").collect()
    sums, sizes, want = {}, {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        sums[r.k], sizes[r.k] = sums.get(r.k, 0) + r.v, sizes.get(r.k, 0) + 1
        want[r.id] = (r.k, sums[r.k])
    assert {r.id: (r.k, r.run, r["size"]) for r in got} == {i: (k, s, sizes[k]) for i, (k, s) in want.items()} and len(got) == n


def test_no_call_of_pandas_for_each_trace(spark):
    jobs = spark.range(100).select((F.col("id") % 9).alias("t"), F.col("id").alias("job_id"), F.col("id").alias("arrival_us"), F.lit(5).cast("long").alias("work_us"), F.lit(1.0).alias("score"))
    played = replay.replay(jobs, ["t"], 2, [replay.fcfs_rule(), replay.score_rule()]).join(jobs.drop("t"), "job_id")
    for df in (played, replay.overtaking(played.where("policy = 'SPJF'"), ["t"]), replay.rank_displacement(played.where("policy = 'SPJF'").withColumn("fair", F.lit(2.0)), ["t"], "score", "fair")):
        assert "InPandas" not in df._jdf.queryExecution().toString()
        assert df.count() in (100, 200)


def test_quantiles_by_ranges_equal_percentiles(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"), F.when(F.col("id") % 7 > 0, (F.col("id") * 7_919) % 1_009).alias("v"))
    for p in (0.0, 0.5, 0.99, 1.0):
        want = {r.g: r.q for r in rows.groupBy("g").agg(F.percentile("v", F.lit(p)).alias("q")).collect()}
        assert {r.g: r.q for r in metrics.exact_quantile(rows, ["g"], "v", p, "q").collect()} == want
    waits = rows.selectExpr("'a' AS policy", "v AS wait_us", "0L AS fcfs_us", "g = 1 AS in_window", "false AS heavy", "false AS forced")
    out = metrics.policy_summary(waits, ["policy"])
    assert "percentile" not in out._jdf.queryExecution().toString()
    assert out.first().window_p99_us == waits.where("in_window").agg(F.percentile("wait_us", F.lit(0.99)).alias("q")).first().q


def test_a_grid_is_one_partition(spark):
    from causeway.operators import study

    points = study.grid(spark, [60, 300], [0, 5], [0, 0.1], [300, 600])
    assert points.rdd.getNumPartitions() == 1 and points.distinct().count() == 16
