"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Leading hex digits of the order key that name a bucket: 4096 buckets a group.
BUCKET_DIGITS = 3


#: Rows of an Arrow batch of texts, some of which are very long: a Python worker holds a batch or two.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches have BATCH_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is the one of the session's configuration. Only where none is
    configured and the master is local, as in tests, one is made; on a cluster
    a folder of one machine would be of no use.
    """
    ship(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="causeway-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialise()."""
    spark = df.sparkSession
    root = shared_dir(spark).replace("file:///", "file:/")
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if folder.replace("file:///", "file:/").startswith(root):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(*columns: Column) -> Column:
    """A pseudo-random total order that any engine with md5 can repeat."""
    return F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("null")) for c in columns)))


def running_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, Column], key: str = "order_key", extra: DataFrame | None = None
) -> DataFrame:
    """Exclusive running sums of each group along (key, *order), without one task per group.

    `key` is a hex string; its first digits name a bucket. Sums run inside
    (group, bucket) and the bucket's own start comes from a table of one row
    per group and bucket, so that a group with any share of the rows spreads
    over 4096 parts. `sums` maps an output column to what is summed (nulls
    count as 0); it also yields `<output>_total`, the group's sum. `extra`
    may hold one row per group and is attached on the way.
    """
    # one key for windows and join, null in it being a value like others, so that rows are shuffled once
    df = df.withColumns({"_group": F.struct(*group), "_bucket": F.substring(key, 1, BUCKET_DIGITS)})
    parts = df.groupBy("_group", "_bucket").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(f"_part_{name}") for name, c in sums.items()))
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_group")
    starts = parts.select(
        F.col("_group").alias("_g"),
        F.col("_bucket").alias("_b"),
        *(F.coalesce(F.sum(f"_part_{name}").over(before), F.lit(0)).alias(f"_start_{name}") for name in sums),
        *(F.sum(f"_part_{name}").over(whole).alias(f"{name}_total") for name in sums),
    )
    if extra is not None:
        extra = extra.select(F.struct(*group).alias("_x"), *(c for c in extra.columns if c not in group))
        starts = starts.join(extra, F.col("_g") == F.col("_x")).drop("_x")
    inside = Window.partitionBy("_group", "_bucket").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    for name, column in sums.items():
        df = df.withColumn(f"_inside_{name}", F.coalesce(F.sum(F.coalesce(column, F.lit(0))).over(inside), F.lit(0)))
    on = [F.col("_group") == F.col("_g"), F.col("_bucket") == F.col("_b")]
    joined = df.join(starts, on)
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_inside_{name}") + F.col(f"_start_{name}"))
    return joined.drop("_group", "_bucket", "_g", "_b", *(f"_inside_{n}" for n in sums), *(f"_start_{n}" for n in sums))
