"""Cubes in Z order: keys, ranges, and what a chip reads."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skyweave.sources import zorder


def by_bits(y, x):
    y, x, out = y + zorder.HALF, x + zorder.HALF, 0
    for i in range(31):
        out |= ((x >> i & 1) << 2 * i) | ((y >> i & 1) << 2 * i + 1)
    return out


def test_keys(spark):
    rng = np.random.default_rng(71)
    places = [(int(y), int(x)) for y, x in rng.integers(-(2**20), 2**20, (300, 2))] + [(0, 0), (-1, -1), (zorder.HALF - 1, -zorder.HALF), (-zorder.HALF, zorder.HALF - 1)]
    frame = spark.createDataFrame(places, "y int, x int")
    assert [r["z"] for r in frame.select(zorder.key(F.col("y"), F.col("x")).alias("z")).collect()] == [by_bits(*p) for p in places]
    for bad in ((zorder.HALF, 0), (0, -zorder.HALF - 1)):
        with pytest.raises(Exception, match="beyond"):
            spark.createDataFrame([bad], "y int, x int").select(zorder.key(F.col("y"), F.col("x"))).collect()


@pytest.mark.parametrize("most", [1, 4, 32])
def test_ranges_hold_the_box(most):
    rng = np.random.default_rng(72)
    for _ in range(40):
        y0, x0 = (int(v) for v in rng.integers(-40, 40, 2))
        box = (y0, y0 + int(rng.integers(0, 30)), x0, x0 + int(rng.integers(0, 30)))
        found = zorder.ranges(box, most)
        assert 1 <= len(found) <= most and all(a <= b for a, b in found) and all(b < c for (_, b), (c, _) in zip(found, found[1:]))
        assert all(any(a <= by_bits(y, x) <= b for a, b in found) for y in range(box[0], box[1] + 1) for x in range(box[2], box[3] + 1))
    assert zorder.ranges((0, 7, 8, 15), 32) == [(by_bits(0, 8), by_bits(7, 15))] and zorder.ranges((3, 2, 0, 0)) == []
    many = zorder.ranges((5, 40, 5, 40), 32)
    assert sum(b - a + 1 for a, b in many) < 2 * 36 * 36  # little else


def scanned(df):
    """Rows that leave the scan, before any filter above it."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_a_chip_reads_few_row_groups(spark, tmp_path):
    cells = spark.range(512 * 512).select(F.expr("cast(id div 512 as int)").alias("y"), F.expr("cast(id % 512 as int)").alias("x"), F.rand(7).alias("value"), F.lit(1).alias("d"))
    path, plain = str(tmp_path / "z"), str(tmp_path / "rows")
    zorder.write(cells, path, files=8, within=("d",), block_bytes=32 << 10)
    cells.repartitionByRange(8, "y").sortWithinPartitions("y", "x").write.option("parquet.block.size", 32 << 10).parquet(plain)
    box = (200, 231, 300, 331)
    found = zorder.read_box(spark, path, box)
    want = spark.read.parquet(plain).where(F.col("y").between(200, 231) & F.col("x").between(300, 331))
    assert sorted(map(tuple, found.select("y", "x", "d").collect())) == sorted(map(tuple, want.select("y", "x", "d").collect())) and found.count() == 1024
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in glob.glob(f"{path}/*.parquet") for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    z = lambda g: next(g.column(i).statistics for i in range(g.num_columns) if g.column(i).path_in_schema == "z")
    met = sum(any(a <= z(g).max and z(g).min <= b for a, b in zorder.ranges(box)) for g in groups)
    assert len(groups) >= 64 and met <= 0.1 * len(groups)
    assert scanned(zorder.read_box(spark, path, box)) <= 0.1 * 512 * 512
    assert scanned(zorder.read_box(spark, path, box)) < 0.5 * scanned(want)
