"""A stored cube that follows its observations: what arrives late, changes or is withdrawn redoes the days and cells that it touches, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.expr import checked_window
from ..operators.mosaic import daily_mosaic
from ..operators.temporal import fill_rows
from ..sources.shared import read_parts, replace_parts, stored

CELL = ("band", "y", "x")


_KINDS = {"source_id": LongType(), "band": StringType(), "y": IntegerType(), "x": IntegerType(), "d": IntegerType()}
#: The tables of a cube, each in folders by d.
TABLES = {
    name: StructType([StructField(c, _KINDS.get(c, DoubleType())) for c in columns])
    for name, columns in (("observations", ("source_id", *CELL, "dn", "d")), ("cells", (*CELL, "value", "d")), ("filled", (*CELL, "value", "prediction", "filled", "d")))
}


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_parts(spark, f"{path}/{name}", TABLES[name])


def _days(df: DataFrame) -> list[int]:
    """The days that df has, on the driver: no more than the calendar has."""
    return sorted(r["d"] for r in df.select("d").distinct().collect())


def _around(days: list[int], n: int) -> list[int]:
    return sorted({t for d in days for t in range(d - n, d + n + 1)})


def create(observations: DataFrame, grid: DataFrame, path: str, first: int, last: int, max_distance: int) -> None:
    """Valid observations (source_id, d, band, y, x, dn; one row for each source_id), their daily cells and the filled series of the grid from first to last, each a folder for each day."""
    spark = observations.sparkSession

    def write(df: DataFrame, name: str) -> None:
        df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]]).repartition("d").write.partitionBy("d").parquet(f"{path}/{name}")

    write(observations, "observations")
    write(daily_mosaic(_table(spark, path, "observations"), keys=("d", *CELL)), "cells")
    write(fill_rows(_table(spark, path, "cells"), grid.withColumn("d", F.explode(F.sequence(F.lit(first), F.lit(last)))), max_distance), "filled")


def refresh(spark: SparkSession, path: str, changes: DataFrame, first: int, last: int, max_distance: int) -> DataFrame:
    """Bring a cube of create() up to changes, and return the cells that changed: d, band, y, x, before, after.

    changes: source_id, d, band, y, x, dn, withdrawn (boolean). A row that is not withdrawn is the observation as it is now, new or in the place of the one of its source_id
    on that day; a withdrawn one takes that away (its other columns are not read). An observation that moves to another day is withdrawn there and given here. Of several
    rows of one source_id and day, the one not withdrawn counts, of those the greatest in the order of their columns. Withdrawing what is not there, or giving what is already there, changes nothing.

    Read and written are the folders of the days that the changes touch and, of the filled series, those within max_distance of a day on which a cell's value has become another;
    rows there that no changed cell is near to are copied, not computed. Each table is put in place by days, from rows written aside, so a refresh that was cut short can be run again.
    """
    n = checked_window(max_distance)
    observations, cells, filled = (_table(spark, path, name) for name in TABLES)
    key = ["source_id", "d"]
    own = changes.select(*key, *CELL, "dn", F.coalesce("withdrawn", F.lit(False)).alias("withdrawn"))
    latest = F.max_by(F.struct(*CELL, "dn", "withdrawn"), F.struct(~F.col("withdrawn"), *CELL, "dn"))
    given = stored(own.groupBy(*key).agg(latest.alias("c")).select(*key, "c.*"), "changes")
    touched = _days(given)
    if not touched:
        return spark.createDataFrame([], "d int, band string, y int, x int, before double, after double")

    kept = observations.where(F.col("d").isin(touched)).join(given.select(*key), key, "left_anti")
    names = TABLES["observations"].names
    replace_parts(kept.select(*names).unionByName(given.where(~F.col("withdrawn")).select(*names)), f"{path}/observations", "d", touched)

    now = stored(daily_mosaic(_table(spark, path, "observations").where(F.col("d").isin(touched)), keys=("d", *CELL)), "mosaics")
    was = cells.where(F.col("d").isin(touched)).withColumnRenamed("value", "before")
    both = was.join(now.withColumnRenamed("value", "after"), ["d", *CELL], "full")
    changed = stored(both.where(~F.col("before").eqNullSafe(F.col("after"))).select("d", *CELL, "before", "after"), "changed")
    days = _days(changed)
    if not days:
        return changed
    replace_parts(now.where(F.col("d").isin(days)).select(*TABLES["cells"].names), f"{path}/cells", "d", days)

    near = [d for d in _around(days, n) if first <= d <= last]
    old = filled.where(F.col("d").isin(near))
    reached = changed.select(*CELL, F.explode(F.sequence(F.col("d") - n, F.col("d") + n)).alias("d")).where(F.col("d").between(first, last)).distinct()
    asked = reached.join(old.select("d", *CELL), ["d", *CELL], "left_semi")  # cells off the grid are in no series
    source = _table(spark, path, "cells").where(F.col("d").isin(_around(near, n)))
    again = fill_rows(source.join(asked.select(*CELL).distinct(), list(CELL), "left_semi"), asked, n)
    names = TABLES["filled"].names
    replace_parts(old.join(reached, ["d", *CELL], "left_anti").select(*names).unionByName(again.select(*names)), f"{path}/filled", "d", near)
    return changed


def filled_series(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """band, y, x, d, value, prediction, filled of the stored cube; days first to last alone are read, where given."""
    out = _table(spark, path, "filled")
    out = out if first is None else out.where(F.col("d") >= first)
    out = out if last is None else out.where(F.col("d") <= last)
    return out.select(*CELL, "d", "value", "prediction", "filled")
