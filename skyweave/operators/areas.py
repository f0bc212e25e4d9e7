"""Areas of interest: polygons with holes, by the crossings of their edges with the grid's rows."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import Geographic, Grid, Sinusoidal, TransverseMercator

#: Columns of a tile along a grid row: a span of a row meets the cells of the tiles that it touches, not a row's all.
TILE = 256


def rings_of(geometry: Column) -> Column:
    """All rings of a GeoJSON Polygon or MultiPolygon, as arrays of [x, y]; null for anything else. Outer and inner rings need no telling apart: even-odd crossings count both."""
    parsed = F.from_json(geometry, "type string, coordinates string")
    rings = "array<array<array<double>>>"
    return F.when(parsed["type"] == "Polygon", F.from_json(parsed["coordinates"], rings)).when(parsed["type"] == "MultiPolygon", F.flatten(F.from_json(parsed["coordinates"], f"array<{rings}>")))


def row_range(geometry: str, grid: Grid) -> tuple[int, int]:
    """The first and the last grid row that a GeoJSON geometry in the grid's projection can touch, for the scan; (0, -1) if none."""

    def heights(part: list) -> Iterator[float]:
        for x in part:
            yield from [part[1]] if not isinstance(x, list) else heights(x)

    *_, e, f = grid.transform
    rows = [(y - f) / e - 0.5 for y in heights(json.loads(geometry)["coordinates"])]
    return (max(0, math.floor(min(rows))), min(grid.height - 1, math.ceil(max(rows)))) if rows else (0, -1)


def edges(areas: DataFrame, rings: Column) -> DataFrame:
    """area, x1, y1, x2, y2 of every edge; rings that are not closed are. Points with a missing or infinite part raise an error when the query runs; rings of fewer than two points have no edge."""
    ring = areas.select("area", F.explode(rings).alias("ring")).where(F.size("ring") > 1)
    point = lambda p: F.when(p[0].isNotNull() & p[1].isNotNull() & (F.abs(p[0]) < float("inf")) & (F.abs(p[1]) < float("inf")), p).otherwise(F.raise_error(F.lit("a ring has a point without finite x and y")))
    closed = ring.select("area", F.transform("ring", point).alias("ring")).select("area", F.concat("ring", F.slice("ring", 1, 1)).alias("ring"))
    pairs = F.transform(F.slice("ring", F.lit(1), F.size("ring") - 1), lambda p, i: F.struct(p[0].alias("x1"), p[1].alias("y1"), F.get("ring", i + 1)[0].alias("x2"), F.get("ring", i + 1)[1].alias("y2")))
    return closed.select("area", F.explode(pairs).alias("e")).select("area", "e.*")


def spans(areas: DataFrame, rings: Column, grid: Grid, given: Geographic | Sinusoidal | TransverseMercator | None = None) -> DataFrame:
    """area, y, start, end: along the centres of grid row y an area holds the projected x with start <= x < end.

    A row's centre line is crossed by the edges one of whose ends lies above it while the other does not; between the first and the second crossing, the third
    and the fourth, and so on, lies the area, whatever its rings' order, holes and islands. Each edge goes to the rows it crosses, so the index has a row for each
    crossing. given: the projection of the rings, where it is not the grid's; its corners are projected, edges stay straight on the grid.
    """
    a, b, _, d, e, f = grid.transform
    if b or d:
        raise ValueError("rows of the grid must lie along x")
    own = edges(areas, rings)
    if given is not None and given != grid.projection:
        for x, y in (("x1", "y1"), ("x2", "y2")):
            px, py = grid.projection.forward(*given.inverse(F.col(x), F.col(y)))
            own = own.withColumn("_px", px).withColumn(y, py).withColumn(x, F.col("_px")).drop("_px")
    row = lambda y: (F.col(y) - f) / e - 0.5
    first, last = F.greatest(F.floor(F.least(row("y1"), row("y2"))), F.lit(0)), F.least(F.ceil(F.greatest(row("y1"), row("y2"))), F.lit(grid.height - 1))
    met = own.withColumn("_first", first).withColumn("_last", last).where("_first <= _last").withColumn("y", F.explode(F.sequence("_first", "_last")))
    line = met.withColumn("_c", e * (F.col("y") + 0.5) + f).where((F.col("y1") > F.col("_c")) != (F.col("y2") > F.col("_c")))
    crossed = line.select("area", F.col("y").cast("int").alias("y"), ((F.col("x2") - F.col("x1")) * (F.col("_c") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("at"))
    along = crossed.groupBy("area", "y").agg(F.sort_array(F.collect_list("at")).alias("at"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("at") / 2).cast("int") - 1), lambda i: F.struct(F.get("at", 2 * i).alias("start"), F.get("at", 2 * i + 1).alias("end")))
    return along.select("area", "y", F.explode(pairs).alias("s")).select("area", "y", "s.start", "s.end").where("start < end")


def _met(cells: DataFrame, found: DataFrame, grid: Grid, how: str) -> DataFrame:
    a, _, c, _, _, _ = grid.transform
    column = lambda x: (F.col(x) - c) / a - 0.5
    first, last = F.greatest(F.floor(F.least(column("start"), column("end"))), F.lit(0)), F.least(F.ceil(F.greatest(column("start"), column("end"))), F.lit(grid.width - 1))
    tiled = found.withColumn("_a", F.floor(first / TILE)).withColumn("_b", F.floor(last / TILE)).where("_a <= _b").select(F.col("y").alias("_y"), "area", "start", "end", F.explode(F.sequence("_a", "_b")).alias("_t"))
    at = a * (F.col("x") + 0.5) + c
    on = (F.col("y") == F.col("_y")) & (F.floor(F.col("x") / TILE) == F.col("_t")) & (at >= F.col("start")) & (at < F.col("end"))
    return cells.join(tiled, on, how)


def within(cells: DataFrame, found: DataFrame, grid: Grid) -> DataFrame:
    """cells (y, x, ...) whose centres lie in any of the areas, each once: a semi join by row and tile."""
    return _met(cells, found, grid, "left_semi")


def by_area(cells: DataFrame, found: DataFrame, grid: Grid) -> DataFrame:
    """area and cells, a row for each area that a cell's centre lies in. The spans of an area along a row do not overlap, so a cell comes once for an area."""
    return _met(cells, found, grid, "inner").select("area", *cells.columns)
