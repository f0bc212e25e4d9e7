"""Fusing a sharp, rare sensor with a coarse, daily one. All values are reflectances on the fine grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, normalized_difference
from .temporal import fill_days


def pair_weights(t1: int, t2: int, when: int) -> tuple[float, float]:
    if t1 == t2:
        raise ValueError("the two reference days are one")
    return (t2 - when) / (t2 - t1), (when - t1) / (t2 - t1)


def dual_residual(l1: Column, m1: Column, l2: Column, m2: Column, mt: Column, w1: float | Column, w2: float | Column, bounds: tuple[float, float] | None = (0.0, 1.0)) -> Column:
    """mt + w1 (l1 - m1) + w2 (l2 - m2); any missing part makes it missing, not a bound."""
    v = mt + w1 * (l1 - m1) + w2 * (l2 - m2)
    return v if bounds is None else clip(v, *bounds)


def single_delta(l_golden: Column, m_golden: Column, m_target: Column) -> Column:
    return l_golden + (m_target - m_golden)


def single_residual(l1: Column, m1: Column, mt: Column, bounds: tuple[float, float] | None = (0.0, 1.0)) -> Column:
    v = mt + (l1 - m1)
    return v if bounds is None else clip(v, *bounds)


def fuse_date(fine: DataFrame, coarse: DataFrame, grid: DataFrame, golden: int, when: int, first: int, last: int, max_distance: int = 32, keys: Sequence[str] = ("band", "y", "x")) -> DataFrame:
    """Difference transfer from a golden day to `when`: coarse gaps of both days are filled in time from the season [first, last], in one pass, then added to the golden fine image.

    keys: columns of coarse and grid that name a coarse cell, so that filling works on coarse cells and only its result meets the fine grid.
    """
    season = coarse.where(F.col("d").between(first, last))
    sharp = fine.where(F.col("d") == golden).select("band", "y", "x", F.col("value").alias("l_golden"))
    both = fill_days(season, {"m_golden": golden, "m_target": when}, max_distance, keys)
    j = grid.join(sharp, ["band", "y", "x"], "left").join(both, list(keys), "left")
    return j.withColumn("fused", single_delta(F.col("l_golden"), F.col("m_golden"), F.col("m_target")))


def window_fusion(rules: DataFrame, coarse: DataFrame) -> DataFrame:
    """Rules (band, y, x, alpha, beta) of a golden day applied to coarse images on the fine grid (band, y, x, value and whatever else, such as a day): `fused` = alpha * value + beta."""
    return coarse.join(rules.select("band", "y", "x", "alpha", "beta"), ["band", "y", "x"]).withColumn("fused", F.col("alpha") * F.col("value") + F.col("beta")).drop("alpha", "beta")


def fused_index(fused: DataFrame, nir: str, red: str, keys: list[str]) -> DataFrame:
    """keys and the normalised difference of two bands of fused images."""
    wide = fused.where(F.col("band").isin(nir, red)).groupBy(*keys).pivot("band", [nir, red]).agg(F.max("fused"))
    return wide.select(*keys, normalized_difference(F.col(nir), F.col(red)).alias("ndvi"))
