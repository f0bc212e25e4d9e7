"""Mosaics and observation counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bits_clear, reflectance


def daily_mosaic(observations: DataFrame, keys: Sequence[str] = ("day", "d", "band", "y", "x")) -> DataFrame:
    """Of the valid observations of a key, the one of the greatest source_id. A partial and a final hash aggregate, no sort."""
    return observations.where("dn is not null").groupBy(*keys).agg(F.max_by("dn", "source_id").alias("value"))


def prepared(observations: DataFrame, bands: Sequence[str], mask: int = 63, image: Sequence[str] = ("sensor", "d", "y", "x")) -> DataFrame:
    """Observations (with qa and radsat) of these bands as reflectances: quality bits clear, nothing saturated, and every band valid at that place of that image.

    The bands share a mask: a cell that one of them lacks is missing in all. Negative reflectances stay.
    """
    good = observations.where(F.col("band").isin(*bands) & bits_clear(F.col("qa"), mask) & (F.col("radsat") == 0) & F.col("dn").isNotNull())
    valid = F.size(F.collect_set("band").over(Window.partitionBy(*image)))
    return good.withColumn("_n", valid).where(F.col("_n") == len(set(bands))).drop("_n").withColumn("value", reflectance(F.col("dn")))


def quality_mosaic(cells: DataFrame, when: int) -> DataFrame:
    """For each band and cell the value and day nearest `when`, the earlier one on a tie, that day itself left out."""
    best = F.max_by(F.struct("value", "d"), F.struct(-F.abs(F.col("d") - when), -F.col("d")))
    return cells.where(F.col("d") != when).groupBy("band", "y", "x").agg(best.alias("b")).select("band", "y", "x", F.col("b.value").alias("value"), F.col("b.d").alias("d"))


def common_support(cells: DataFrame, bands: int, value: str = "value") -> DataFrame:
    """Cells of which every band is valid, day by day."""
    over = Window.partitionBy("d", "y", "x")
    return cells.withColumn("_n", F.count(value).over(over)).where(F.col("_n") == bands).drop("_n")


def observation_counts(cells: DataFrame, grid: DataFrame) -> DataFrame:
    counted = cells.groupBy("band", "y", "x").agg(F.count("value").alias("n"))
    return grid.join(counted, ["band", "y", "x"], "left").select("band", "y", "x", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def support_histogram(counts: DataFrame, scale: float = 30.0) -> DataFrame:
    """Cells by number of observations, their area in square kilometres, and their share in percent, band by band."""
    hist = counts.groupBy("band", "n").agg(F.count("*").alias("cells"))
    total = hist.groupBy("band").agg(F.sum("cells").alias("total"))
    return hist.join(total, "band").select("band", "n", "cells", F.round(F.col("cells") * (scale * scale / 1e6), 6).alias("area_km2"), F.round(100.0 * F.col("cells") / F.col("total"), 4).alias("percent"))
