"""Shared parts of the operators: the shared folder, stored tables, bindings inside expressions, two-level ranks."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skyweave-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Lower the session's rows of an Arrow batch while jobs run inside: batches hold whole texts, and two workers and the JVM share an executor's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), rows) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that columns an operator adds beside it can't clash with them; `select("name.*")` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def uniform(key: Column, salt: str) -> Column:
    """A number in (0, 1) from the top 52 bits of the MD5 of a key as text (null as no text) and a salt: the same in any engine."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{salt}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def many_buckets(rows: int) -> int:
    """As many buckets as there are rows in one: neither the buckets nor the table of their sums grows faster than the root of the rows."""
    return max(1, math.isqrt(rows))


def long_list(values: Sequence[int]) -> Column:
    """A list of whole numbers as one literal: the optimizer folds it, and the driver makes one call into the JVM, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def by_size(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of a text column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most)))
        yield batch.slice(at, end - at)
        at = end


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def scan(values: Column) -> Column:
    """[0, v0, v0+v1, ...] of a short array of longs."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def prefix_sums(values: Column, block: int = 256) -> Column:
    """For each element the sum of those before it. Blocks keep the copying linear in long arrays."""

    def whole(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: F.slice(v, b * block + 1, F.lit(block)))
        return let(cut, lambda blocks: let(
            scan(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y))),
            lambda starts: F.flatten(F.transform(blocks, lambda x, i: F.transform(F.slice(scan(x), F.lit(1), F.size(x)), lambda y: y + F.get(starts, i)))),
        ))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<bigint>")))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str, value: Column | None = None, few: bool = False) -> DataFrame:
    """Add `name`: the sum of `value` (default 1, so a rank from 0) over the rows before each row, within keys.

    Rows are ordered by bucket, then `order`. A key with a third of all rows is no single task: rows are
    sorted within (keys, bucket) only, and the buckets' sums are added up in a small table. df is read
    twice, so it should be stored. few: the caller has bounded the number of keys times buckets, so that table is
    broadcast and df's rows are shuffled once; else they are shuffled a second time to meet it.
    """
    value = F.lit(1).cast("long") if value is None else value
    slim = df.withColumn("_r_bucket", bucket).withColumn("_r_value", value)
    sums = slim.groupBy(*keys, "_r_bucket").agg(F.sum("_r_value").alias("_r_sum"))
    over = Window.partitionBy(*keys).orderBy("_r_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_r_bucket").alias("_r_b"), F.coalesce(F.sum("_r_sum").over(over), F.lit(0)).cast("long").alias("_r_before"))
    same = slim["_r_bucket"] == F.col("_r_b")
    for k in keys:
        same = same & slim[k].eqNullSafe(F.col(f"_r_{k}"))
    inner = Window.partitionBy(*keys, "_r_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        slim.withColumn("_r_inner", F.coalesce(F.sum("_r_value").over(inner), F.lit(0)))
        .join(F.broadcast(starts) if few else starts, same, "left")
        .withColumn(name, (F.col("_r_before") + F.col("_r_inner")).cast("long"))
        .drop("_r_bucket", "_r_value", "_r_inner", "_r_b", "_r_before", *[f"_r_{k}" for k in keys])
    )
