"""Raster files as a source and a sink."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.sources import raster

ROWS = "image string, band string, y int, x int, value double"


@pytest.fixture
def scenes():
    rng = np.random.default_rng(81)
    return [(f"day {d}", b, y, x, None if (y + x) % 5 == 0 else float(rng.normal())) for d in (3, 1, 2) for b in ("red", "nir") for y in range(150) for x in range(9) if rng.random() < 0.9 and not (d == 2 and b == "red")]


def put(spark, rows, path, **more):
    raster.write_rasters(spark.createDataFrame(rows, ROWS).repartition(4), path, **({"width": 9, "height": 150, "bands": ["nir", "red"], "transform": [30, 0, 600_000, 0, -30, 5_000_010]} | more))


def cells(df):
    return {(r["image"], r["band"], r["y"], r["x"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("split", [64 << 20, 3000])
def test_there_and_back(spark, tmp_path, monkeypatch, scenes, split):
    monkeypatch.setattr(raster, "SPLIT", split)
    path = str(tmp_path / "out")
    put(spark, scenes, path, epsg=32633, tags={"sensor": "fine", "units": "ä"})
    assert sorted(os.listdir(path)) == ["day 1.tif", "day 2.tif", "day 3.tif"]
    got = cells(raster.read_rasters(spark, path))
    own = {r[:4]: r[4] for r in scenes}
    assert len(got) == 3 * 2 * 150 * 9 and all(v == own.get(k) for k, v in got.items())
    head = raster.header_of(f"{path}/day 2.tif")
    assert head.nodata == -9999 and head.epsg == 32633 and head.transform == [30, 0, 600_000, 0, -30, 5_000_010] and head.bands == ["nir", "red"]
    assert head.described == {"sensor": "fine", "units": "ä", "bands": ["nir", "red"]}
    assert cells(raster.read_rasters(spark, f"file:{path}/day 3.tif")).keys() == {k for k in got if k[0] == "day 3"}
    parts = raster.RasterReader({"path": path}).partitions()
    assert len(parts) == (3 if split > 1 << 20 else 3 * -(-os.path.getsize(f"{path}/day 1.tif") // 3000))
    put(spark, [("day 1", "nir", 0, 0, 42.0)], path)  # replaced, the others stay
    assert cells(raster.read_rasters(spark, path).where("value is not null and image <> 'day 3' and image <> 'day 2'")) == {("day 1", "nir", 0, 0): 42.0}


@pytest.mark.parametrize("bad", [("day 9", "blue", 0, 0, 1.0), ("day 9", "nir", 150, 0, 1.0), ("day 9", "nir", 0, -1, 1.0), ("day 1", "nir", 149, 8, 1.0), ("a/b", "nir", 0, 0, 1.0), (None, "nir", 0, 0, 1.0)])
def test_a_failed_task_leaves_no_file(spark, tmp_path, scenes, bad):
    rows = [r for r in scenes if r[0] != "day 1"] + [("day 1", "nir", 149, 8, 2.0)]
    path = str(tmp_path / "out")
    put(spark, [("kept", "nir", 1, 1, 3.0)], path)
    with pytest.raises(Exception, match="not a name|no such cell|come twice"):
        put(spark, [*rows, bad], path)
    assert os.listdir(path) == ["kept.tif"]
    assert cells(raster.read_rasters(spark, path).where("value is not null")) == {("kept", "nir", 1, 1): 3.0}


def test_other_writers_files(spark, tmp_path):
    """Big-endian, two samples a pixel, deflate, 16-bit numbers, no description; and what is refused."""
    values = np.arange(2 * 6 * 5, dtype=">i2").reshape(6, 5, 2)
    strips = [zlib.compress(values[a : a + 4].tobytes()) for a in (0, 4)]
    tags = {256: ("H", [5]), 257: ("H", [6]), 258: ("H", [16, 16]), 259: ("H", [8]), 273: ("I", [0, 0]), 277: ("H", [2]), 278: ("H", [4]), 279: ("I", [len(s) for s in strips]), 339: ("H", [2, 2]), 42113: ("s", b"7\0")}

    def whole(tags):
        end = 8 + 2 + 12 * len(tags) + 4
        extra, rows = b"", b""
        place = end + sum(len(v) * struct.calcsize("=" + k) for k, v in tags.values() if k != "s" and len(v) * struct.calcsize("=" + k) > 4)
        tags[273] = ("I", [place, place + len(strips[0])])
        for tag, (letter, v) in sorted(tags.items()):
            raw = v if letter == "s" else struct.pack(f">{len(v)}{letter}", *v)
            rows += struct.pack(">HHI", tag, {"H": 3, "I": 4, "s": 2}[letter], len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", end + len(extra)))
            extra += raw if len(raw) > 4 else b""
        return b"MM\0*" + struct.pack(">IH", 8, len(tags)) + rows + b"\0\0\0\0" + extra + b"".join(strips)

    (tmp_path / "a.tif").write_bytes(whole(tags))
    got = cells(raster.read_rasters(spark, str(tmp_path / "a.tif")))
    assert got == {("a", str(s + 1), y, x): None if values[y, x, s] == 7 else float(values[y, x, s]) for y in range(6) for x in range(5) for s in range(2)}
    (tmp_path / "b.tif").write_bytes(whole(tags | {317: ("H", [2])}))
    (tmp_path / "c.tif").write_bytes(b"PK\3\4 no raster")
    for name in ("b", "c"):
        with pytest.raises(Exception, match="strips without|plain form"):
            raster.read_rasters(spark, str(tmp_path / f"{name}.tif")).collect()


def test_edges(spark, tmp_path):
    path = str(tmp_path / "none")
    put(spark, [], path)
    assert os.listdir(path) == [] and raster.read_rasters(spark, path).count() == 0
    with pytest.raises(ValueError):
        raster.encode_header(40_000, 40_000, ["a"], transform=[1, 0, 0, 0, -1, 0], epsg=None, nodata=None, tags={})
    turned = raster.encode_header(4, 3, ["a"], transform=[3, 1, 10, -1, 3, 20], epsg=None, nodata=None, tags={})[0] + b"\0" * 96
    (tmp_path / "t.tif").write_bytes(turned)
    head = raster.header_of(str(tmp_path / "t.tif"))
    assert head.transform == [3, 1, 10, -1, 3, 20] and head.epsg is None and head.nodata is None
    assert raster.read_rasters(spark, str(tmp_path / "t.tif")).agg(F.sum("value")).first()[0] == 0
