"""An overview pyramid: each level's cells are two by two of the level below, as sums that merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..sources.shared import new_path

MERGED = ("total", "count", "least", "most")


def _level(below: DataFrame, keys: Sequence[str]) -> DataFrame:
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return below.groupBy(*keys, half("y"), half("x")).agg(F.sum("total").alias("total"), F.sum("count").alias("count"), F.min("least").alias("least"), F.max("most").alias("most"))


def build(cells: DataFrame, levels: int, keys: Sequence[str] = ("band",)) -> DataFrame:
    """keys, y, x, total, count, least, most, level: level 0 holds the valid cells, a cell (y, x) of level k the 2**k * 2**k cells from (y * 2**k, x * 2**k) on.

    Every level comes from the one below in one aggregate, of a quarter of the rows at best, and is a folder of the result, which lies in the shared folder.
    Cells without a value are in no level; several rows of one place and key count together.
    """
    if levels < 0:
        raise ValueError(f"no such number of levels: {levels}")
    spark, path = cells.sparkSession, new_path(cells.sparkSession, "pyramid")
    value = F.col("value").cast("double")
    level = cells.where(F.col("value").isNotNull()).groupBy(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(F.sum(value).alias("total"), F.count("*").alias("count"), F.min(value).alias("least"), F.max(value).alias("most"))
    for k in range(levels + 1):
        level.write.parquet(f"{path}/level={k}")
        level = _level(spark.read.schema(level.schema).parquet(f"{path}/level={k}"), keys)
    return spark.read.schema(level.schema.add("level", IntegerType())).parquet(path)


def _inside(box: tuple[int, int, int, int], y: Column, x: Column, level: Column) -> Column:
    """Whether a cell (y, x) of a level lies in the box (y0, y1, x0, x1 in cells of level 0, ends included) with all of its part."""
    size = F.pow(F.lit(2), level).cast("long")
    y, x = y * size, x * size
    return (y >= box[0]) & (y + size - 1 <= box[1]) & (x >= box[2]) & (x + size - 1 <= box[3])


def region(pyramid: DataFrame, box: tuple[int, int, int, int], keys: Sequence[str] = ("band",)) -> DataFrame:
    """keys, n, total, mean, least, most of the valid cells of a box, exact: its inside from the highest level that fits, its rim from ever lower ones.

    A cell counts if it lies inside and the one above it does not, so each place counts once; about as many rows are read as the box's rim is long, not its area.
    """
    top = pyramid.agg(F.max("level")).first()[0]
    if top is None:
        top = 0
    level = F.col("level")
    parent = (level < top) & _inside(box, F.floor(F.col("y") / 2), F.floor(F.col("x") / 2), level + 1)
    near = F.lit(False)
    for k in range(top + 1):  # plain ranges, which reach the scan of each level's folder
        low, high = (box[0] >> k, box[2] >> k), (box[1] >> k, box[3] >> k)
        near = near | ((level == k) & F.col("y").between(low[0], high[0]) & F.col("x").between(low[1], high[1]))
    own = pyramid.where(near & _inside(box, F.col("y"), F.col("x"), level) & ~parent)
    return own.groupBy(*keys).agg(F.sum("count").alias("n"), F.sum("total").alias("total"), (F.sum("total") / F.sum("count")).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"))


def region_at(pyramid: DataFrame, box: tuple[int, int, int, int], level: int, keys: Sequence[str] = ("band",)) -> DataFrame:
    """keys, mean, low, high of a box from one level alone: cells across the rim count by the share of their area that lies inside, as if their values were spread evenly.

    The true mean of the box lies between low, the smaller of the mean of the cells wholly inside and the least value of those across the rim, and high, the greater of that
    mean and their greatest value; at level 0 no cell lies across and all three are the mean. Boxes that no cell meets have no row.
    """
    size = 1 << level
    overlap = lambda c, a, b: F.greatest(F.least(F.col(c) * size + size, F.lit(b + 1)) - F.greatest(F.col(c) * size, F.lit(a)), F.lit(0))
    met = pyramid.where((F.col("level") == level) & F.col("y").between(box[0] >> level, box[1] >> level) & F.col("x").between(box[2] >> level, box[3] >> level))
    met = met.withColumn("_area", overlap("y", *box[:2]) * overlap("x", *box[2:])).where("_area > 0").withColumn("_share", F.col("_area") / float(size * size)).withColumn("_rim", F.col("_area") < size * size)
    whole, rim = (lambda c: F.when(~F.col("_rim"), c)), (lambda c: F.when(F.col("_rim"), c))
    g = met.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("total") * F.col("_share")), F.sum(F.col("count") * F.col("_share"))).alias("mean"),
        F.try_divide(F.sum(whole(F.col("total"))), F.sum(whole(F.col("count")))).alias("_own"), F.min(rim(F.col("least"))).alias("_least"), F.max(rim(F.col("most"))).alias("_most"))
    return g.select(*keys, "mean", F.least("_own", "_least").alias("low"), F.greatest("_own", "_most").alias("high"))
