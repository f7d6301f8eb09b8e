"""Sinks: parquet, CSV, LaTeX tables, manifests with hashes, resumable results."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, a folder per term or the like, overwriting only the parts at hand."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV with full precision."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def latex(df: DataFrame, macro: str = "num", digits: int = 2, rows: int = 200) -> str:
    """A report of few rows as a LaTeX tabular with numbers in a macro."""

    def cell(x) -> str:
        if x is None:
            return "--"
        if isinstance(x, bool) or isinstance(x, str):
            return str(x).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
        return rf"\{macro}{{{x:.{digits}f}}}" if isinstance(x, float) else rf"\{macro}{{{x}}}"

    found = df.take(rows + 1)
    if len(found) > rows:
        raise ValueError(f"a table of over {rows} rows isn't for print")
    head = " & ".join(c.replace("_", r"\_") for c in df.columns)
    body = "\n".join(" & ".join(cell(x) for x in r) + r" \\" for r in found)
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{head} \\\\\n\\hline\n{body}\n\\end{{tabular}}\n"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify(known: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Files whose content changed, went missing, or are new since the manifest `known`."""
    now = manifest(spark, path).select("path", F.col("sha256").alias("now"))
    both = known.select("path", F.col("sha256").alias("before")).join(now, "path", "full")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("before").isNull(), "new").when(F.col("now") != F.col("before"), "changed")
    return both.withColumn("state", state).where("state is not null").select("path", "state")


def signed(spark: SparkSession, folder: str, signature: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gave for this signature, from the folder if it is stored whole, else made and stored."""
    path = f"{folder}/{hashlib.sha256(signature.encode()).hexdigest()}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_cells(traces: DataFrame, folder: str, cell: Sequence[str]) -> None:
    """Traces by cell, each sorted by arrival in files of its own, for replays that read a cell at a time."""
    dealt = traces.repartition(*cell).sortWithinPartitions(*cell, "arrival_us", "job_id")
    dealt.write.mode("overwrite").partitionBy(*cell).parquet(folder)


def remaining(tasks: DataFrame, done_path: str, key: Sequence[str]) -> DataFrame:
    """Tasks that have no stored result yet, so that a long run resumes."""
    spark = tasks.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(done_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return tasks
    return tasks.join(spark.read.parquet(done_path).select(*key).distinct(), list(key), "left_anti")
