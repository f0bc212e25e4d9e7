"""Neighbourhoods on the grid. Only valid neighbours count; a cell without any is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import circle_offsets


def _widths(radius: float) -> list[int]:
    """For dy of 0, 1, ... how far a circle reaches along x."""
    return [max(dx for y, dx in circle_offsets(radius) if y == dy) for dy in range(int(radius) + 1)]


def _merged(how: str, widths: list[int]) -> dict:
    """Names and partial aggregates of each width."""
    if how not in ("avg", "max"):
        raise ValueError(f"no such statistic: {how!r}")
    return {f"{f}{w}": f for w in sorted(set(widths)) for f in (("sum", "count") if how == "avg" else ("max",))}


def focal(cells: DataFrame, radius: float, how: str = "avg", value: str = "value") -> DataFrame:
    """avg or max over a circle, at every place that a valid cell reaches, on the grid or beyond.

    Values are sent along x, where a partial aggregate for each width of the circle meets, then these along y: 2 (2 r + 1) rows for a cell, not the circle's area, and no join.
    """
    widths = _widths(radius)
    parts = _merged(how, widths)
    reach = lambda c, n: F.explode(F.sequence(c - n, c + n))
    along_x = cells.where(F.col(value).isNotNull()).select("band", "y", F.col("x").alias("_x"), F.col(value).cast("double").alias("_v"), reach(F.col("x"), max(widths)).alias("x"))
    within = lambda w: F.when(F.abs(F.col("x") - F.col("_x")) <= w, F.col("_v"))
    rows = along_x.groupBy("band", "y", "x").agg(*[getattr(F, f)(within(int(name[len(f):]))).alias(name) for name, f in parts.items()])
    along_y = rows.select("band", F.col("y").alias("_y"), "x", *parts, reach(F.col("y"), len(widths) - 1).alias("y"))
    far = F.abs(F.col("y") - F.col("_y"))
    at = lambda f: F.coalesce(*[F.when(far == dy, F.col(f"{f}{w}")) for dy, w in enumerate(widths)])
    grouped = along_y.groupBy("band", "y", "x")
    if how == "max":
        out = grouped.agg(F.max(at("max")).alias("focal"))
    else:
        out = grouped.agg(F.try_divide(F.sum(at("sum")), F.sum(at("count"))).alias("focal"))
    return out.where("focal is not null")


def focal_on_grid(cells: DataFrame, radius: float, value: str, name: str = "focal") -> DataFrame:
    """cells with the mean of `value` over a circle, for tables that have a row for each cell of the grid: two window passes, no row is sent anywhere else."""
    widths = _widths(radius)
    parts = _merged("avg", widths)
    line = Window.partitionBy("band", "y").orderBy("x")
    column = Window.partitionBy("band", "x").orderBy("y")
    rows = cells.select("*", *[getattr(F, f)(F.col(value)).over(line.rangeBetween(-int(k[len(f):]), int(k[len(f):]))).alias(f"_{k}") for k, f in parts.items()])
    total = lambda f: sum((F.coalesce(F.sum(f"_{f}{widths[abs(d)]}").over(column.rangeBetween(d, d)), F.lit(0)) for d in range(1 - len(widths), len(widths))), F.lit(0.0))
    return rows.select(*cells.columns, F.try_divide(total("sum"), total("count")).alias(name))


def box_sums(cells: DataFrame, radius: int, columns: dict) -> DataFrame:
    """Sums over a square of 2 radius + 1 cells: along x, then along y. Two shuffles whatever the radius; needs a row for each cell of the grid."""
    along_x = Window.partitionBy("band", "y").orderBy("x").rangeBetween(-radius, radius)
    along_y = Window.partitionBy("band", "x").orderBy("y").rangeBetween(-radius, radius)
    rows = cells.select("*", *[c.alias(f"_{k}") for k, c in columns.items()])
    rows = rows.select(*cells.columns, *[F.sum(f"_{k}").over(along_x).alias(f"_{k}") for k in columns])
    return rows.select(*cells.columns, *[F.sum(f"_{k}").over(along_y).alias(k) for k in columns])


def fill_square(cells: DataFrame, radius: int, rounds: int = 2) -> DataFrame:
    """Missing values from the mean of a square, again and again; valid ones stay."""
    for _ in range(rounds):
        s = box_sums(cells, radius, {"total": F.col("value"), "count": F.col("value").isNotNull().cast("int")})
        cells = s.select("band", "y", "x", F.coalesce("value", F.when(F.col("count") > 0, F.col("total") / F.col("count"))).alias("value"))
    return cells


def moving_fit(pairs: DataFrame, radius: int) -> DataFrame:
    """alpha, beta of fine = alpha * coarse + beta over a square around each cell, from pairs both of which are valid."""
    both = F.col("fine").isNotNull() & F.col("coarse").isNotNull()
    on = lambda c: F.when(both, c)
    m, v = F.col("coarse"), F.col("fine")
    s = box_sums(pairs, radius, {"n": on(F.lit(1.0)), "sm": on(m), "sv": on(v), "smv": on(m * v), "smm": on(m * m)})
    det = F.col("n") * F.col("smm") - F.col("sm") * F.col("sm")
    alpha = F.when((F.col("n") > 1) & (det > 1e-9 * F.col("n") * F.col("smm")), (F.col("n") * F.col("smv") - F.col("sm") * F.col("sv")) / det)
    return s.withColumn("alpha", alpha).withColumn("beta", (F.col("sv") - F.col("alpha") * F.col("sm")) / F.col("n")).select(*pairs.columns, "alpha", "beta")


def edge_blend(stages: DataFrame, radius: float = 1.5, patched: str = "patched", raw: str = "raw") -> DataFrame:
    """The focal mean of the patched image where raw is missing, raw where it is valid. stages has a row for each cell of the grid."""
    return focal_on_grid(stages, radius, patched, "_focal").withColumn("blended", F.coalesce(raw, "_focal")).drop("_focal")


def feather(stages: DataFrame, radius: float = 5.0, raw: str = "raw", local: str = "patched") -> DataFrame:
    """raw * w + local * (1 - w) with w the focal mean of raw's mask. raw is the masked target; where it is missing w counts as 0, so nothing withheld leaks. stages has a row for each cell of the grid."""
    masked = stages.withColumn("_mask", F.col(raw).isNotNull().cast("double"))
    w = F.when(F.col(raw).isNotNull(), F.col("_focal")).otherwise(0.0)
    return focal_on_grid(masked, radius, "_mask", "_focal").withColumn("feathered", F.coalesce(F.col(raw), F.lit(0.0)) * w + F.col(local) * (1 - w)).drop("_focal", "_mask")


def water_guarded_mask(pixels: DataFrame, radius: float = 6.0, occurrence: float = 20) -> DataFrame:
    """pixels (band, y, x, bad, nir, red, green, water_bit, occurrence, cloud_bit) with `masked`: dilated bad cells or dark land, never water (above `occurrence` percent of the time, by its bit or by its index), and every cloud."""
    grown = focal(pixels.where("bad").select("band", "y", "x", F.lit(1.0).alias("value")), radius, "max")
    j = pixels.join(grown, ["band", "y", "x"], "left")
    water = F.col("water_bit") | (F.coalesce("occurrence", F.lit(0.0)) > occurrence) | F.coalesce((F.col("green") - F.col("nir")) / F.when(F.col("green") + F.col("nir") != 0, F.col("green") + F.col("nir")) > 0, F.lit(False))
    shadow = F.coalesce((F.col("nir") < 12000) & (F.col("red") < 9000), F.lit(False)) & ~water
    return j.withColumn("masked", ((F.col("focal").isNotNull() | shadow) & ~water) | F.col("cloud_bit")).drop("focal")
