"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder as configured; on a local master alone one is made."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="causeway-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def written(rows: DataFrame, name: str, **options: object) -> DataFrame:
    """`rows` as a table of the shared folder: lineage is cut, and lost executors take nothing with them."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.options(**options).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def dropped(rows: DataFrame) -> None:
    """Delete a table made by written()."""
    spark = rows.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
