"""Tables that are written to be read again: the folder that driver and executors share, and partitions that are put in others' place."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skyweave-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_parts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A partitioned table, which may be empty: then it has no file to take its schema from."""
    return spark.read.schema(schema).parquet(path)


def replace_parts(df: DataFrame, path: str, by: str, parts: Sequence[int]) -> None:
    """Put df's rows in the place of all rows of these values of the partition column; other partitions are not touched.

    df is written aside first, so that it may be read from path itself. Values without any row lose their partition.
    """
    spark = df.sparkSession
    new = stored(df, "parts")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    left = {r[0] for r in new.select(by).distinct().collect()}
    for part in sorted(set(parts) - left):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={part}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
