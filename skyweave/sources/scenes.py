"""An archive by day and tile, and the index of its scenes that says which of them need not be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Grid rows of a tile.
TILE_ROWS = 64
INDEX = "d int, tile int, n long, cloudy long, y0 int, y1 int, x0 int, x1 int"


def write_archive(observations: DataFrame, path: str, cloudy: Column, tile_rows: int = TILE_ROWS) -> None:
    """observations (d, y, x, ...) in a folder for each day and tile of grid rows, and the index beside them: how many observations a tile's scene has, how many are cloudy, and its extent.

    The index has a row for each folder, so it stays small beside what it stands for; a new day adds its rows to both.
    """
    tiled = observations.withColumn("tile", F.floor(F.col("y") / tile_rows).cast("int"))
    tiled.repartition("d", "tile").write.mode("append").partitionBy("d", "tile").parquet(f"{path}/observations")
    own = tiled.groupBy("d", "tile").agg(F.count("*").alias("n"), F.count_if(cloudy).alias("cloudy"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    own.write.mode("append").parquet(f"{path}/index")


def index_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def scenes(index: DataFrame) -> DataFrame:
    """d and cloud (percent of all its tiles' observations) of each day, from the index alone."""
    return index.groupBy("d").agg((100 * F.sum("cloudy") / F.sum("n")).alias("cloud"))


def read_archive(spark: SparkSession, path: str, *, most_cloud: float | None = None, days: tuple[int, int] | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The observations of days below most_cloud percent of cloud (of the whole day's scene), within days and within box (y0, y1, x0, x1), all ends included.

    What the index rules out is not read: days and rows by the folders' names, days that are too cloudy and tiles whose extent misses the box by the join with the
    index, whose rows reach the scan as it starts. Only the index is broadcast: as many rows as the days and tiles that are asked for.
    """
    wanted = index_of(spark, path)
    if days is not None:
        wanted = wanted.where(F.col("d").between(*days))
    if most_cloud is not None:
        clear = scenes(wanted).where(F.col("cloud") < most_cloud).select("d")
        wanted = wanted.join(clear, "d", "left_semi")
    if box is not None:
        wanted = wanted.where((F.col("y1") >= box[0]) & (F.col("y0") <= box[1]) & (F.col("x1") >= box[2]) & (F.col("x0") <= box[3]))
    # a name of its own, and a test that any index passes: the scan is pruned for the sake of a join with a filter alone
    wanted = wanted.where(F.col("n") > 0).select(F.col("d").alias("_d"), F.col("tile").alias("_tile"))
    rows = spark.read.parquet(f"{path}/observations")
    rows = rows if days is None else rows.where(F.col("d").between(*days))
    rows = rows if box is None else rows.where(F.col("y").between(*box[:2]) & F.col("x").between(*box[2:]))
    return rows.join(F.broadcast(wanted), (F.col("d") == F.col("_d")) & (F.col("tile") == F.col("_tile")), "left_semi").drop("tile")


def clearest(index: DataFrame, n: int = 1) -> DataFrame:
    """The n days of the least cloud, the earliest of ties, without a look at any observation."""
    return scenes(index).orderBy("cloud", "d").limit(n)
