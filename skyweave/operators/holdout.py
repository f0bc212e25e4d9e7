"""Which cells are withheld for validation: boolean columns of x and y."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Centre and radii along x and y of the cloud pattern's ellipses, as shares of the grid.
ELLIPSES = ((0.49, 0.51, 0.23, 0.28), (0.65, 0.40, 0.14, 0.17))


def holdout(x: Column, y: Column, width: int, height: int, pattern: str = "cloud") -> Column:
    """cloud: two ellipses; stripes: slanted; scene: all."""
    if pattern == "scene":
        return F.lit(True)
    if pattern == "stripes":
        return (x + F.floor(y / 2)) % max(10, width // 7) < max(3, width // 22)
    if pattern != "cloud":
        raise ValueError(f"no such pattern: {pattern!r}")
    u, v = x.cast("double") / width, y.cast("double") / height

    def ellipse(cx: float, cy: float, rx: float, ry: float) -> Column:
        a, b = (u - cx) / rx, (v - cy) / ry
        return a * a + b * b < 1

    return ellipse(*ELLIPSES[0]) | ellipse(*ELLIPSES[1])


def diagonal_gap(x: Column, y: Column, spacing: int = 40, width: int = 15, scale: int = 30) -> Column:
    return F.pmod(x + y, F.lit(spacing * scale)) <= width * scale


def disc_gap(x: Column, y: Column, width: int, height: int, share: float = 0.32, dy: int = 0, dx: int = 0) -> Column:
    r = share * min(width, height)
    a, b = y - (height // 2 + dy), x - (width // 2 + dx)
    return a * a + b * b <= r * r


def other_day_gap(cells: DataFrame, grid: DataFrame, day: int) -> DataFrame:
    """grid with `held`: cells that another day does not show."""
    seen = cells.where((F.col("d") == day) & F.col("value").isNotNull()).select("band", "y", "x", F.lit(True).alias("seen"))
    return grid.join(seen, ["band", "y", "x"], "left").select("band", "y", "x", F.col("seen").isNull().alias("held"))
