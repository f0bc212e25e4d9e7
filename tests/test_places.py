"""Areas, projections and grids that do not nest, against brute-force versions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave import catalog
from skyweave.functions import projection as P
from skyweave.operators import areas, resample

FLAT = P.Geographic()


def inside(rings, px, py):
    """Crossings of a ray to the right, over all rings."""
    n = 0
    for ring in filter(None, rings):
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                n += 1
    return n % 2 == 1


@pytest.mark.parametrize("transform", [(1, 0, 0, 0, 1, 0), (30, 0, 600_000, 0, -30, 5_000_000), (0.25, 0, -3, 0, -0.5, 6)])
def test_areas_against_crossings(spark, monkeypatch, transform):
    """Random rings that cross themselves, holes, islands, rings through cell centres, areas beyond the grid."""
    monkeypatch.setattr(areas, "TILE", 4)
    rng = np.random.default_rng(31)
    a, _, c, _, e, f = transform
    grid = P.Grid(FLAT, transform, 17, 13)
    at = lambda col, row: [float(a * col + c), float(e * row + f)]
    own = {k: [[at(*rng.uniform(-4, 20, 2)) for _ in range(rng.integers(2, 9))] for _ in range(rng.integers(1, 4))] for k in range(12)}
    own[12] = [[at(2.5, 2.5), at(9.5, 2.5), at(9.5, 8.5), at(2.5, 8.5), at(2.5, 2.5)]]  # corners on centres, closed already
    own[13] = [[at(-9, -9), at(-5, -9), at(-5, -5)]]
    own[14] = [[at(3, 3)], []]
    own[15] = [[at(0, 0), at(17, 0), at(17, 13), at(0, 13)], [at(4, 4), at(4, 9), at(11, 9), at(11, 4)], [at(6, 5), at(8, 5), at(8, 8), at(6, 8)]]
    frame = spark.createDataFrame([(k, json.dumps({"type": "Polygon", "coordinates": r})) for k, r in own.items()] + [(99, None), (98, "{}"), (97, '{"type": "Point", "coordinates": [1, 2]}')], "area int, geometry string")
    cells = spark.createDataFrame([(y, x) for y in range(13) for x in range(17)], "y int, x int")
    found = areas.spans(frame, areas.rings_of(F.col("geometry")), grid)
    want = {(k, y, x) for k, rings in own.items() for y in range(13) for x in range(17) if inside(rings, *at(x + 0.5, y + 0.5))}
    got = [tuple(r) for r in areas.by_area(cells, found, grid).select("area", "y", "x").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({k for k, *_ in want}) > 9
    assert sorted(tuple(r) for r in areas.within(cells, found, grid).collect()) == sorted({k[1:] for k in want})
    for k in own:
        low, high = areas.row_range(json.dumps({"coordinates": own[k]}), grid)
        assert all(low <= y <= high for j, y, _ in want if j == k)


def test_areas_of_another_projection(spark):
    """Corners in degrees on a grid in metres; a missing corner is an error."""
    zone, grid = P.utm(33), P.Grid(P.utm(33), (100, 0, 500_000, 0, -100, 5_210_000), 40, 30)
    ring = [(500_420.0, 5_209_710.0), (503_810.0, 5_209_230.0), (502_050.0, 5_207_310.0)]
    lon, lat = zone.inverse(F.col("x"), F.col("y"))
    degrees = [tuple(r) for r in spark.createDataFrame(ring, "x double, y double").select(lon, lat).collect()]
    frame = spark.createDataFrame([(1, [degrees])], "area int, rings array<array<array<double>>>")
    cells = spark.createDataFrame([(y, x) for y in range(30) for x in range(40)], "y int, x int")
    found = areas.within(cells, areas.spans(frame, F.col("rings"), grid, P.Geographic()), grid)
    assert {tuple(r) for r in found.collect()} == {(y, x) for y in range(30) for x in range(40) if inside([ring], 500_050 + 100 * x, 5_209_950 - 100 * y)}
    with pytest.raises(Exception, match="without finite"):
        areas.spans(spark.createDataFrame([(1, [[[0.0, 1.0], [None, 2.0], [3.0, 3.0]]])], frame.schema), F.col("rings"), grid).collect()


def test_the_aoi_is_no_cross_join_and_prunes_its_rows(spark, middle, capsys):
    catalog.queries()["aoi_polygon"](spark, middle).explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "GreaterThanOrEqual(user_id," in plan


def test_projections_there_and_back(spark):
    rng = np.random.default_rng(32)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(11.5, 18.5, 200), rng.uniform(-75, 75, 200))]
    frame = spark.createDataFrame(rows, "lon double, lat double")
    for p in (P.Geographic(), P.Sinusoidal(), P.utm(33), P.utm(33, south=True), P.Sinusoidal(meridian=10.0)):
        x, y = p.forward(F.col("lon"), F.col("lat"))
        lon, lat = p.inverse(F.col("x"), F.col("y"))
        for r in frame.withColumn("x", x).withColumn("y", y).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
            assert r["a"] == pytest.approx(r["lon"], abs=1e-9) and r["b"] == pytest.approx(r["lat"], abs=1e-9)
    for zone in (0, 61, True, 3.0):
        with pytest.raises(ValueError):
            P.utm(zone)


def test_known_places(spark):
    """A tower's published coordinates, the length of a meridian to 45 degrees, a sphere's equator."""
    one = spark.createDataFrame([(-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600), (-81.0, 45.0)], "lon double, lat double")
    tower, meridian = [tuple(r) for r in one.select(*P.utm(17).forward(F.col("lon"), F.col("lat"))).collect()]
    assert tower == (pytest.approx(630_084, abs=1), pytest.approx(4_833_439, abs=1))
    assert meridian == (pytest.approx(500_000, abs=1e-6), pytest.approx(0.9996 * 4_984_944.378, abs=2e-3))
    x, y = spark.range(1).select(*P.Sinusoidal(1.0).forward(F.lit(90.0), F.lit(60.0))).first()
    assert x == pytest.approx(math.pi / 4) and y == pytest.approx(math.pi / 3)


def test_a_turned_grid_finds_its_cells_again(spark):
    grid = P.Grid(FLAT, (20, 3, 100, -2, -25, 900), 30, 40)
    px, py = grid.centre(F.col("x"), F.col("y"))
    cells = spark.createDataFrame([(y, x) for y in range(40) for x in range(30)], "y int, x int").withColumn("px", px).withColumn("py", py)
    for r in cells.select("y", "x", *[c.alias(n) for c, n in zip(grid.place(F.col("px"), F.col("py")), ("gx", "gy"))]).collect():
        assert r["gx"] == pytest.approx(r["x"], abs=1e-9) and r["gy"] == pytest.approx(r["y"], abs=1e-9)
    with pytest.raises(ValueError):
        P.Grid(FLAT, (1, 2, 0, 2, 4, 0), 3, 3)


def test_regridding_against_a_loop(spark):
    """A step 16.7 times as wide, another corner, gaps, two values at once, fine cells beyond the coarse grid."""
    rng = np.random.default_rng(33)
    coarse_grid, fine_grid = P.Grid(FLAT, (16.7, 0, -11.0, 0, -16.7, 47.3), 5, 4), P.Grid(FLAT, (1, 0, -20, 0, -1, 50), 110, 80)
    values = {(b, y, x): (float(rng.normal()), float(rng.normal()) if rng.random() < 0.8 else None) for b in "rg" for y in range(4) for x in range(5) if rng.random() < 0.9}
    coarse = spark.createDataFrame([(*k, *v) for k, v in values.items()], "band string, cy int, cx int, a double, b double")
    fine = spark.createDataFrame([(b, y, x) for b in "rg" for y in range(0, 80, 3) for x in range(0, 110, 3)], "band string, y int, x int")
    n = 0
    for r in resample.regrid(coarse, fine, coarse_grid, fine_grid, ("a", "b")).collect():
        gx, gy = (-20 + r["x"] + 0.5 + 11.0) / 16.7 - 0.5, (47.3 - (50 - r["y"] - 0.5)) / 16.7 - 0.5
        for k, name in enumerate("ab"):
            want = 0.0
            for dy in (0, 1):
                for dx in (0, 1):
                    v = values.get((r["band"], min(3, max(0, math.floor(gy) + dy)), min(4, max(0, math.floor(gx) + dx))), (None, None))[k]
                    wy, wx = gy - math.floor(gy), gx - math.floor(gx)
                    want = None if v is None or want is None else want + v * (wy if dy else 1 - wy) * (wx if dx else 1 - wx)
            if not (-0.5 <= gx <= 4.5 and -0.5 <= gy <= 3.5):
                want = None
            n += want is not None
            assert r[name] == (want if want is None else pytest.approx(want, abs=1e-12))
    assert n > 500


def test_regridding_reads_the_coarse_image_once(spark, middle, capsys):
    for name, scans in (("bilinear_resample", 3), ("fusion_single_delta", 5), ("fuse_regridded", 4)):
        catalog.queries()[name](spark, middle).explain("formatted")
        plan = capsys.readouterr().out.split("===== Subqueries")[0]
        assert plan.count("Location:") <= scans and "NestedLoop" not in plan and "Cartesian" not in plan, name
