"""A table's fingerprint: digests of its rows, added up, so that neither their order nor their partitions matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType

#: Digits of a digest that are added up together: sums of 32-bit numbers, exact in 38 digits for any number of rows.
PART = 8


def _text(value: Column, kind: DataType) -> Column:
    """A value as text that no other value of its kind has."""
    if isinstance(kind, BinaryType):
        return F.hex(value)
    return F.to_json(value) if isinstance(kind, (ArrayType, MapType, StructType)) else value.cast("string")


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """MD5 over the columns in the order of their names: each one's name and value with their lengths, `-` for null, so that nothing runs together."""
    parts = []
    for c in sorted(columns or df.columns):
        text = _text(F.col(f"`{c}`"), df.schema[c].dataType)
        parts.append(F.coalesce(F.concat(F.lit(f"{len(c)}:{c}="), F.length(text).cast("string"), F.lit(":"), text), F.lit(f"{len(c)}:{c}=-")))
    return F.md5(F.concat_ws(";", *parts).cast("binary"))


def sums(df: DataFrame, *by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """by, n and s0 to s3: what merges. Sums of two tables' rows, added, are those of both together: a day's can be kept and added to others'."""
    digest = df.select(*by, row_digest(df, columns).alias("_digest"))
    part = lambda i: F.conv(F.substring("_digest", 1 + i * PART, PART), 16, 10).cast("decimal(20,0)")
    return digest.groupBy(*by).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)])


def merged(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(f"s{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)])


def digest(merged: DataFrame, *by: str) -> DataFrame:
    """by, n and the fingerprint: SHA-256 over the row count and the four sums."""
    return merged.select(*by, "n", F.sha2(F.concat_ws(":", "n", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def fingerprint(df: DataFrame, *by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """by, n, digest: the same for any order and partitioning of the rows, another after any value, row or repetition changes. One aggregate; a row for each group.

    An empty table has n = 0 and a digest of its own (without `by`; with it there is no group). Columns count by name, so their order does not matter.
    """
    return digest(sums(df, *by, columns=columns), *by)
