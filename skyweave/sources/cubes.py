"""Observations and cells from the driver's tables, and the cached cube with its manifest."""

from __future__ import annotations

import datetime
import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import checked_date, finite
from ..operators.mosaic import daily_mosaic

EPOCH = "1970-01-01"
BANDS, UNITS = ("SR_B5", "SR_B4", "SR_B3"), "surface_reflectance"
#: Bands of the cubes made from the driver's tables.
EVENT_BANDS, PART_BANDS = ("click", "error", "purchase", "signup", "view"), ("A", "N", "R")
EVENT_COLUMNS, PART_COLUMNS = 15, 50
RESOLUTION = 30


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _midnight(d: int) -> Column:
    return F.lit(datetime.datetime(1970, 1, 1) + datetime.timedelta(days=d)).cast("timestamp_ntz")


def event_observations(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """Events as observations: users are grid cells of 15 columns, types are bands, props.k is the quality mask. Days first to last and grid rows from rows[0] to rows[1] alone are read, where given."""
    e = read(spark, folder, "events")
    e = e if first is None else e.where(F.col("ts") >= _midnight(first))
    e = e if last is None else e.where(F.col("ts") < _midnight(last + 1))
    e = e if rows is None else e.where(F.col("user_id").between(rows[0] * EVENT_COLUMNS, (rows[1] + 1) * EVENT_COLUMNS - 1))
    return e.select(
        F.col("event_id").alias("source_id"), "ts", F.to_date("ts").alias("day"), F.datediff(F.to_date("ts"), F.lit(EPOCH).cast("date")).alias("d"), F.col("event_type").alias("band"),
        F.expr("cast(user_id div 15 as int)").alias("y"), F.expr("cast(user_id % 15 as int)").alias("x"), F.get_json_object("props", "$.k").cast("int").alias("qa"), finite(F.col("value")).alias("dn"))


def dense_grid(spark: SparkSession, shape: tuple[int, int], bands: Sequence[str]) -> DataFrame:
    """Every cell of a grid of `shape` (rows, columns) with every band of the sensor; outputs start from it, so that what is missing is not lost. No observation is read."""
    place = spark.range(shape[0] * shape[1])
    return place.select(F.expr(f"cast(id div {shape[1]} as int)").alias("y"), F.expr(f"cast(id % {shape[1]} as int)").alias("x")).withColumn("band", F.explode(F.lit(list(bands))))


def rows_of(spark: SparkSession, folder: str, table: str, key: str, columns: int) -> int:
    """How many grid rows of `columns` cells the greatest key of a table needs: what a manifest would say. One aggregate over one column; no rows, no grid."""
    most = read(spark, folder, table).agg(F.max(key)).first()[0]
    return 0 if most is None else most // columns + 1


def part_observations(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Line items as yearly observations of parts: source_id orders them, its last digit is the quality mask. Years first to last alone are read, where given."""
    i = read(spark, folder, "lineitem")
    i = i if first is None else i.where(F.col("l_shipdate") >= F.lit(datetime.datetime(first, 1, 1)).cast("timestamp_ntz"))
    i = i if last is None else i.where(F.col("l_shipdate") < F.lit(datetime.datetime(last + 1, 1, 1)).cast("timestamp_ntz"))
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_id")
    return i.groupBy(F.col("l_partkey").alias("px"), F.col("l_returnflag").alias("band"), F.year("l_shipdate").alias("d"), key).agg(F.max("l_extendedprice").alias("dn"))


def part_cells(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    clear = part_observations(spark, folder, first, last).where((F.col("source_id") % 10).bitwiseAND(F.lit(4)) == 0)
    return daily_mosaic(clear, keys=("d", "band", "px"))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    p = read(spark, folder, "part")
    return p.select(F.col("p_partkey").alias("px"), F.expr("cast(p_partkey % 50 as int)").alias("x"), F.expr("cast(p_partkey div 50 as int)").alias("y"), F.expr("cast(case when p_size = 50 and p_partkey % 3 = 0 then 4 else p_size % 4 end as int)").alias("seg"))


def part_grid(spark: SparkSession, folder: str) -> DataFrame:
    return segments(spark, folder).withColumn("band", F.explode(F.lit(list(PART_BANDS))))


def snapped(minimum: float, maximum: float, step: float = RESOLUTION) -> tuple[float, float, int]:
    """A range widened to whole steps, and how many there are."""
    low, high = (minimum // step) * step, -((-maximum // step) * step)
    return low, high, int(round((high - low) / step))


def chip_grid(x: float, y: float, size_m: float, step: int = RESOLUTION) -> dict:
    """transform, width and height of a square chip around a point in projected metres, its upper left corner on whole steps."""
    size = math.ceil(size_m / step)
    left, top = snapped(x - size_m / 2, x, step)[0], snapped(y, y + size_m / 2, step)[1]
    return {"transform": [step, 0, left, 0, -step, top], "width": size, "height": size}


def checked_manifest(manifest: dict) -> dict:
    """Units, bands, a grid of 10 to 512 cells a side in a projected system on whole steps, and a target date; anything else raises ValueError."""
    if manifest.get("units") != UNITS:
        raise ValueError(f"units must be {UNITS}")
    if tuple(manifest.get("bands", ())) != BANDS:
        raise ValueError(f"bands must be {BANDS}")
    for side in ("width", "height"):
        if not 10 <= int(manifest.get(side, 0)) <= 512:
            raise ValueError(f"{side} must be 10 to 512")
    if not re.fullmatch(r"EPSG:\d{4,5}", str(manifest.get("crs", ""))) or manifest["crs"] == "EPSG:4326":
        raise ValueError("crs must be a projected system, as EPSG:number")
    t = manifest.get("transform", ())
    if len(t) != 6 or t[1] or t[3] or not t[0] > 0 or t[4] != -t[0] or t[2] % t[0] or t[5] % t[0]:
        raise ValueError("transform must be [step, 0, left, 0, -step, top] on whole steps")
    checked_date(manifest.get("target_date"))
    return manifest


def checked_cells(cells: DataFrame, manifest: dict) -> DataFrame:
    """cells (day, band, y, x, value), if they lie on the manifest's grid, have its bands and hold its target date; one aggregate finds out."""
    outside = ~F.col("y").between(0, manifest["height"] - 1) | ~F.col("x").between(0, manifest["width"] - 1) | F.col("y").isNull() | F.col("x").isNull()
    found = cells.agg(F.count_if(outside).alias("outside"), F.count_if(~F.col("band").isin(*manifest["bands"])).alias("other"), F.count_if(F.col("day") == F.lit(manifest["target_date"]).cast("date")).alias("target")).first()
    if found["outside"]:
        raise ValueError(f"{found['outside']} cells lie outside the grid")
    if found["other"]:
        raise ValueError(f"{found['other']} cells are of other bands")
    if not found["target"]:
        raise ValueError("the target date is absent")
    return cells


def clear_fractions(cells: DataFrame, manifest: dict) -> dict[str, float]:
    """For each day the share of the grid's cells whose bands are all valid. A row for each day goes to the driver."""
    whole = cells.where("value is not null").groupBy("day", "y", "x").agg(F.countDistinct("band").alias("n"))
    days = whole.groupBy("day").agg(F.count_if(F.col("n") == len(manifest["bands"])).alias("n")).collect()
    return {r["day"].isoformat(): r["n"] / (manifest["width"] * manifest["height"]) for r in days}


def write_cube(cells: DataFrame, path: str, manifest: dict) -> None:
    """Cells by day and band as Parquet, the manifest beside them as one JSON row, with the clear share of each day."""
    checked_cells(cells, checked_manifest(manifest))
    cells.write.partitionBy("day", "band").parquet(f"{path}/cells")
    whole = manifest | {"qa_clear_fraction_by_date": clear_fractions(cells, manifest)}
    cells.sparkSession.createDataFrame([(json.dumps(whole, allow_nan=False),)], "manifest string").coalesce(1).write.text(f"{path}/manifest")


def read_cube(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    manifest = checked_manifest(json.loads(spark.read.text(f"{path}/manifest").first()[0]))
    return checked_cells(spark.read.parquet(f"{path}/cells"), manifest), manifest
