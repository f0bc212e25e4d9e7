"""Coarse grids on fine ones: bilinear, whether the grids nest or differ in step, origin and projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import Grid


def _corners(c: str, last: int) -> Column:
    """(start of a square, whether c is its far side) along one axis; beyond the edges the last cell stands for both sides."""
    one = lambda at, far: F.struct(at.cast("long").alias("at"), F.lit(far).alias("far"))
    none = F.array().cast("array<struct<at:bigint,far:int>>")
    low = F.when(F.col(c) == 0, F.array(one(F.lit(-1), 0))).otherwise(none)
    high = F.when(F.col(c) == last, F.array(one(F.col(c), 1))).otherwise(none)
    return F.explode(F.concat(F.array(one(F.col(c), 0), one(F.col(c) - 1, 1)), low, high))


def bilinear_at(coarse: DataFrame, fine: DataFrame, row: Column, column: Column, shape: tuple[int, int], values: Sequence[str] = ("value",), by: Sequence[str] = ("band",)) -> DataFrame:
    """fine with the `values` of coarse (by, cy, cx) at fractional rows and columns of its grid of `shape` (rows, columns): of four neighbours, all of which must be valid.

    Places up to half a cell beyond the outermost centres take the last cell for both sides, those further out are missing. Each coarse
    cell goes to the squares of four that it is a corner of, so that fine cells meet their square's values, all of them, in one join; the grid's shape is an argument, so nothing is read for it.
    """
    last = [n - 1 for n in shape]
    sent = coarse.withColumn("_y", _corners("cy", last[0])).withColumn("_x", _corners("cx", last[1]))
    is_ = lambda fy, fx, v: F.max(F.when((F.col("_y.far") == fy) & (F.col("_x.far") == fx), F.col(v)))
    sides = [(fy, fx) for fy in (0, 1) for fx in (0, 1)]
    squares = sent.groupBy(*by, F.col("_y.at").alias("_oy"), F.col("_x.at").alias("_ox")).agg(*[is_(fy, fx, v).alias(f"_{v}{fy}{fx}") for v in values for fy, fx in sides])
    inside = lambda g, n: g.between(-0.5, n + 0.5)
    start = lambda g, n: F.when(inside(g, n), F.floor(g))
    placed = fine.withColumn("_gy", row).withColumn("_gx", column).withColumn("_oy", start(F.col("_gy"), last[0])).withColumn("_ox", start(F.col("_gx"), last[1]))
    wy, wx = F.col("_gy") - F.floor("_gy"), F.col("_gx") - F.floor("_gx")
    weight = lambda far, w: w if far else 1 - w
    mixed = lambda v: sum((F.col(f"_{v}{fy}{fx}") * (weight(fy, wy) * weight(fx, wx)) for fy, fx in sides[1:]), F.col(f"_{v}00") * ((1 - wy) * (1 - wx)))
    return placed.join(squares, [*by, "_oy", "_ox"], "left").select(*[F.col(c) for c in fine.columns], *[mixed(v).alias(v) for v in values])


def bilinear(coarse: DataFrame, fine: DataFrame, factor: int, shape: tuple[int, int], values: Sequence[str] = ("value",)) -> DataFrame:
    """Coarse values (band, cy, cx) at fine cells (band, y, x) where a coarse cell is `factor` fine ones wide and the grids share a corner."""
    return bilinear_at(coarse, fine.select("band", "y", "x"), (F.col("y") + 0.5) / factor - 0.5, (F.col("x") + 0.5) / factor - 0.5, shape, values)


def regrid(coarse: DataFrame, fine: DataFrame, coarse_grid: Grid, fine_grid: Grid, values: Sequence[str] = ("value",)) -> DataFrame:
    """Coarse values (band, cy, cx) at fine cells (band, y, x) of a grid of another projection, step or origin. Fine cells outside the coarse grid are missing."""
    column, row = coarse_grid.seen_from(fine_grid)(F.col("x"), F.col("y"))
    return bilinear_at(coarse, fine.select("band", "y", "x"), row, column, (coarse_grid.height, coarse_grid.width), values)
