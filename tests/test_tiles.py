"""Neighbourhoods on tiles give the rows of those on cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave import catalog
from skyweave.operators import focal, tiles

CELLS = "band string, y int, x int, value double"


def near(got, want, *names):
    """The same cells, and values that agree to rounding."""
    rows = lambda df: {(r["band"], r["y"], r["x"]): tuple(r[n] for n in names) for r in df.collect()}
    got, want = rows(got), rows(want)
    assert got.keys() == want.keys() and got
    for k, own in want.items():
        assert all(b is None and a is None or a == pytest.approx(b, abs=1e-9) for a, b in zip(got[k], own)), (k, got[k], own)


@pytest.fixture(scope="module")
def sparse(spark):
    """Cells far below and above zero, a lone cell, rows without a value, tiles without a row."""
    rng = np.random.default_rng(41)
    rows = [(b, y, x, float(rng.normal()) if rng.random() < 0.7 else None) for b in "pq" for y in range(-9, 12) for x in range(-3, 19) if rng.random() < 0.4]
    return spark.createDataFrame([*rows, ("p", 60, -70, 5.0)], CELLS)


@pytest.fixture(scope="module")
def dense(spark):
    rng = np.random.default_rng(42)
    some = lambda share: float(rng.normal()) if rng.random() < share else None
    rows = [(b, y, x, some(0.3), some(0.8)) for b in "pq" for y in range(17) for x in range(23)]
    return spark.createDataFrame(rows, "band string, y int, x int, raw double, patched double")


@pytest.mark.parametrize("how", ["avg", "max"])
@pytest.mark.parametrize(("radius", "side"), [(1.5, 4), (3.0, 3), (5.0, 7), (2.9, 64)])
def test_circles(sparse, how, radius, side):
    near(tiles.focal(sparse, radius, how, side), focal.focal(sparse, radius, how), "focal")


@pytest.mark.parametrize(("radius", "rounds", "side"), [(2, 2, 4), (1, 3, 5), (4, 1, 32)])
def test_squares_are_filled(dense, radius, rounds, side):
    cells = dense.select("band", "y", "x", F.when((F.col("y") > 6) | (F.col("x") < 5), F.col("raw")).alias("value"))
    near(tiles.fill_square(cells, radius, rounds, side), focal.fill_square(cells, radius, rounds), "value")


def test_fits_blends_and_feathers(dense):
    pairs = dense.select("band", "y", "x", F.col("patched").alias("fine"), (F.col("raw") * 2 + F.col("patched")).alias("coarse"))
    near(tiles.moving_fit(pairs, 3, 5), focal.moving_fit(pairs, 3), "alpha", "beta")
    near(tiles.edge_blend(dense, 1.5, 6), focal.edge_blend(dense), "blended")
    near(tiles.feather(dense, 5.0, 6), focal.feather(dense), "feathered")


def test_tiles_and_back(spark, sparse):
    same = lambda padded, reach: padded[:, reach:-reach, reach:-reach]
    again = tiles.to_cells(tiles.on_tiles(tiles.to_tiles(sparse, side=8), 1, 2, same, side=8), ["value"], side=8)
    assert sorted(map(str, again.collect())) == sorted(map(str, sparse.collect()))
    assert tiles.focal(sparse.where("false"), 1.5).collect() == []
    for reach in (0, 9):
        with pytest.raises(ValueError):
            tiles.on_tiles(tiles.to_tiles(sparse, side=8), 1, reach, lambda padded, reach: padded, side=8)
    with pytest.raises(ValueError):
        tiles.focal(sparse, 1.5, "median")


def test_other_keys(spark):
    """Layers by sensor and day, a key with a null."""
    rows = [(s, d, y, x, float(10 * d + y + x)) for s in ("A", None) for d in (1, 2) for y in range(6) for x in range(6)]
    cells = spark.createDataFrame(rows, "sensor string, d int, y int, x int, value double")
    keys = ("sensor", "d")
    shifted = tiles.on_tiles(tiles.to_tiles(cells, keys=keys, side=4), 1, 1, lambda padded, reach: padded[:, :-2, 1:-1], keys=keys, side=4)
    got = tiles.to_cells(shifted, ["value"], keys=keys, side=4).where("sensor = 'A'").collect()
    assert sorted((r["d"], r["y"], r["x"], r["value"]) for r in got) == sorted((d, y + 1, x, v) for s, d, y, x, v in rows if s and y < 5 or s and y + 1 < 8)


def test_only_borders_move(spark, middle, capsys):
    """Of the exchanges one deals out the cells (a second look at it is reused), the other the borders; what is joined is not dealt out again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = catalog.Events(spark, middle).cell_in(catalog.T, catalog.T)
        out = tiles.focal(cells, 3.0, side=8)
        out.collect()
        out.explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    dealt = [x for x in plan.split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning" in x]
    assert sum("ReusedExchange" in x for x in dealt) == 1 and len(dealt) == 4  # of the mosaic, of the tiles (twice), of the borders
