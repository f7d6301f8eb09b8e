"""Running aggregates by stretches: one key with all rows is no task, and results are those of one sort."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import platform, stretches
from tests.test_platform import SCHEMA, plain, records


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_running_is_a_fold(spark, size):
    rng = random.Random(size)
    rows = [(i, rng.choice([None, "a"]), rng.choice([None, 1, 2]), rng.choice([None, 1, 5]), rng.choice([None, 3, 4]), rng.choice([None, 6, 7])) for i in range(90)]
    df = spark.createDataFrame(rows, "i int, k string, l int, s int, m int, x int")
    df = df.withColumn("stretch", stretches.stretch_of(df, "i", size)(F.col("i")))
    got = stretches.running(df.repartition(5), ["i"], {"a": (["k"], ["s", "m", "x"]), "b": (["k", "l"], ["s", "x"])}, {"s": "sum", "m": "max", "x": "last"})
    found = {r.i: (r.a_s, r.a_m, r.a_x, r.b_s, r.b_x) for r in got.collect()}
    assert len(found) == len(rows)
    for i, k, l, *_ in rows:  # noqa: E741
        of = lambda c, match, i=i: [r[c] for r in rows[: i + 1] if match(r) and r[c] is not None]
        a, b = (lambda r, k=k: r[1] == k), (lambda r, k=k, l=l: r[1:3] == (k, l))  # noqa: E741
        last = lambda xs: xs[-1] if xs else None
        assert found[i] == (sum(of(3, a)) if of(3, a) else None, max(of(4, a), default=None), last(of(5, a)), sum(of(3, b)) if of(3, b) else None, last(of(5, b))), i


def test_a_key_with_all_rows_is_many_tasks(spark):
    df = spark.range(4000).select("id", F.lit(1).alias("k"), F.lit(1).alias("n"), F.floor(F.col("id") / 50).cast("int").alias("stretch"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in stretches.running(df, ["id"], {"a": (["k"], ["n"])}, {"n": "sum"}).where("a_n = id + 1").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2000


@pytest.mark.parametrize("size", [4, 40])
def test_platform_history_by_stretches(spark, size):
    rows = records(120, 3)
    got = {r.id: r.asDict() for r in platform.platform_history(spark.createDataFrame(rows, SCHEMA).repartition(5), 7, size).collect()}
    for i, row in plain(rows, 7).items():
        for name, value in row.items():
            assert got[i][name] == (pytest.approx(value, abs=1e-6) if value is not None else None), (i, name)
