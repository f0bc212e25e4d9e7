"""The scene index, fingerprints, the refreshed cube and the overview pyramid."""

import datetime
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions import fingerprint
from skyweave.operators import pyramid
from skyweave.plans import refresh
from skyweave.sources import scenes

# -- scene index


@pytest.fixture
def archive(spark, tmp_path):
    """Ten days, one in two cloudy, cells of rows 0 to 29 in tiles of 10; day 5 has rows of the first tile alone."""
    rows = [(1000 * d + 100 * y + x, d, y, x, 1 if (d % 2 and (y + x) % 3) else 0) for d in range(10) for y in range(0, 30, 3) for x in range(0, 20, 4) if d != 4 or y < 10]
    frame = spark.createDataFrame(rows, "source_id long, d int, y int, x int, qa int")
    path = str(tmp_path / "archive")
    scenes.write_archive(frame, path, F.col("qa") == 1, tile_rows=10)
    return path, rows


def spoil(path, kept):
    """Put rubbish in the place of every file that need not be read; how many there are."""
    files = [f for f in glob.glob(f"{path}/observations/d=*/tile=*/*.parquet") if not any(f"/d={d}/tile={t}/" in f for d, t in kept)]
    for f in files:
        with open(f, "wb") as out:
            out.write(b"not a table")
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    return len(files)


def test_days_and_tiles_that_the_index_rules_out_are_not_read(spark, archive, capsys):
    path, rows = archive
    found = scenes.read_archive(spark, path, most_cloud=50, days=(1, 7), box=(8, 14, 3, 13))  # a footer is read here, for the schema
    unread = spoil(path, [(d, t) for d in (2, 4, 6) for t in ((0, 1) if d != 4 else (0,))])
    assert unread == 10 * 3 - 2 - 5  # of 28 folders 5 may be read
    want = sorted(r for r in rows if r[1] in (2, 4, 6) and 8 <= r[2] <= 14 and 3 <= r[3] <= 13)
    assert sorted((r["source_id"], r["d"], r["y"], r["x"], r["qa"]) for r in found.collect()) == want and want
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "dynamicpruning" in plan.lower() and "GreaterThanOrEqual(y," in plan


def test_the_index_answers_for_scenes(spark, archive):
    path, rows = archive
    cloud = {d: 100 * np.mean([r[4] for r in rows if r[1] == d]) for d in range(10)}
    got = {r["d"]: r["cloud"] for r in scenes.scenes(scenes.index_of(spark, path)).collect()}
    assert got == {d: pytest.approx(c) for d, c in cloud.items()}
    spoil(path, [])  # no observation is looked at
    assert [r["d"] for r in scenes.clearest(scenes.index_of(spark, path), 2).collect()] == sorted(cloud, key=lambda d: (cloud[d], d))[:2]
    own = scenes.index_of(spark, path).where("d = 4").collect()
    assert [(r["tile"], r["n"], r["cloudy"], r["y0"], r["y1"], r["x0"], r["x1"]) for r in own] == [(0, 20, 0, 0, 9, 0, 16)]


def test_the_archive_grows_by_days(spark, archive):
    path, rows = archive
    more = spark.createDataFrame([(1, 99, 5, 5, 0)], "source_id long, d int, y int, x int, qa int")
    scenes.write_archive(more, path, F.col("qa") == 1, tile_rows=10)
    assert scenes.read_archive(spark, path).count() == len(rows) + 1
    assert [r["source_id"] for r in scenes.read_archive(spark, path, days=(50, 120), most_cloud=1).collect()] == [1]


# -- fingerprints

KINDS = "k long, s string, v double, w float, t timestamp_ntz, b binary, a array<int>, m map<string,int>, f boolean, n decimal(10,2), `odd name` int"
WHEN = datetime.datetime(2021, 3, 4, 5, 6, 7, 800)


@pytest.fixture
def table(spark):
    rows = [(i, f"x{i % 7}", i / 7, i / 3, WHEN, bytes([i % 256]), [i, 2], {"a": i}, i % 2 == 0, None, i) for i in range(300)]
    return spark.createDataFrame([*rows, rows[3], (None,) * 11, (None,) * 11], KINDS)


def one(df, **options):
    return tuple(fingerprint.fingerprint(df, **options).first())


def test_order_and_partitions_do_not_matter(table):
    n, digest = one(table)
    assert n == 303 and len(digest) == 64
    assert {one(table.repartition(7)), one(table.repartition(1, "s").orderBy(F.desc("v"))), one(table.select(*[f"`{c}`" for c in reversed(table.columns)]))} == {(n, digest)}
    halves = fingerprint.sums(table.where("k < 100")).unionByName(fingerprint.sums(table.where("not coalesce(k < 100, false)")))
    assert tuple(fingerprint.digest(fingerprint.merged(halves)).first()) == (n, digest)


def test_any_change_shows(spark, table):
    cell = F.col("k") == 17
    changes = {
        "a value": table.withColumn("v", F.when(cell, F.col("v") + 1e-15).otherwise(F.col("v"))), "a null": table.withColumn("s", F.when(~cell, F.col("s"))), "empty for null": table.withColumn("s", F.coalesce("s", F.lit(""))),
        "a dash for null": table.withColumn("s", F.coalesce("s", F.lit("-"))), "one less": table.where(~cell | cell.isNull()), "one repeated": table.union(table.where(cell)), "another name": table.withColumnRenamed("s", "z"),
        "swapped": table.withColumn("k", F.when(cell, 18).when(F.col("k") == 18, 17).otherwise(F.col("k"))), "a list": table.withColumn("a", F.when(cell, F.array(F.lit(2), F.lit(17))).otherwise(F.col("a"))), "a column": table.withColumn("c", F.lit(1)), "empty": table.where("false"),
    }
    digests = [one(table)[1], *[one(df)[1] for df in changes.values()]]
    assert len(set(digests)) == len(digests)
    two = lambda *r: one(spark.createDataFrame([r], "a string, b string"))  # noqa: E731  values do not run together
    assert two("x;1:b=1:y", "z") != two("x", "y;1:b=1:z")
    by = fingerprint.fingerprint(table, "f").collect()
    assert {r["f"]: r["n"] for r in by} == {True: 150, False: 151, None: 2} and len({r["digest"] for r in by}) == 3
    assert one(table, columns=["k"]) == one(table.select("k"))


# -- refresh

SERIES = "source_id long, d int, band string, y int, x int, dn double"
FIRST, LAST, N = 100, 119, 3


def plain(df):
    return sorted(str((r["band"], r["y"], r["x"], r["d"], r["value"], None if r["prediction"] is None else round(r["prediction"], 9))) for r in df.collect())


def rows_of(rng, ids, days):
    return {int(i): (int(i), int(rng.choice(days)), str(rng.choice(["r", "g"])), int(rng.integers(0, 4)), int(rng.integers(0, 4)), float(rng.integers(0, 50))) for i in ids}


@pytest.fixture
def grid(spark):
    return spark.createDataFrame([(b, y, x) for b in "rg" for y in range(4) for x in range(4)], "band string, y int, x int")


def mtimes(path, table):
    return {os.path.basename(d): max(os.path.getmtime(f) for f in glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{path}/{table}/d=*")}


def test_refresh_equals_a_full_run(spark, tmp_path, grid):
    """Late, changed and withdrawn observations, a day that loses all it had, one that had none, one that moves; twice."""
    rng = np.random.default_rng(51)
    path = str(tmp_path / "cube")
    now = rows_of(rng, range(300), [d for d in range(FIRST - 2, LAST + 3) if d not in (108, 117)])
    refresh.create(spark.createDataFrame(list(now.values()), SERIES), grid, path, FIRST, LAST, N)
    for step in range(2):
        before = mtimes(path, "filled")
        late = rows_of(rng, range(1000 * (step + 1), 1000 * (step + 1) + 12), [108, 109])
        wrong = {i: (*r[:5], r[5] + 7) for i, r in now.items() if r[1] == 107 and i % 2}
        gone = [r for r in now.values() if r[1] == 110] + [(5555, 106, None, None, None, None)]
        moved = next(r for r in now.values() if r[1] == 111)
        changes = [(*r, None) for r in late.values()] + [(*r, False) for r in wrong.values()] + [(*r, True) for r in gone] + [(*moved, True), (moved[0], 109, *moved[2:], False)]
        changes += [(*next(iter(late.values())), False), (*next(iter(wrong.values())), True)]  # repeated; withdrawn and given
        now |= late | wrong
        for r in gone:
            now.pop(r[0], None)
        now[moved[0]] = (moved[0], 109, *moved[2:])
        changed = refresh.refresh(spark, path, spark.createDataFrame(changes, SERIES + ", withdrawn boolean"), FIRST, LAST, N)
        assert changed.count() > 0 and changed.where("before <=> after").count() == 0
        full = str(tmp_path / f"full{step}")
        refresh.create(spark.createDataFrame(list(now.values()), SERIES), grid, full, FIRST, LAST, N)
        assert plain(refresh.filled_series(spark, path)) == plain(refresh.filled_series(spark, full))
        for name in ("observations", "cells"):
            rows = [sorted(map(str, refresh._table(spark, p, name).collect())) for p in (path, full)]
            assert rows[0] == rows[1]
        after = mtimes(path, "filled")
        far = [f"d={d}" for d in range(FIRST, LAST + 1) if not 107 - N <= d <= 111 + N]
        assert all(before[d] == after[d] for d in far) and far  # not written again
    assert refresh.filled_series(spark, path, 105, 106).count() == 64


def test_changes_that_change_nothing(spark, tmp_path, grid):
    path = str(tmp_path / "cube")
    rows = [(1, 105, "r", 0, 0, 4.0), (2, 105, "r", 0, 0, 5.0)]
    refresh.create(spark.createDataFrame(rows, SERIES), grid, path, FIRST, LAST, N)
    before = mtimes(path, "filled")
    same = [(1, 105, "r", 0, 0, 3.0, False), (9, 105, None, None, None, None, True), (2, 105, "r", 0, 0, 5.0, False)]  # the first is behind the second in the mosaic
    assert refresh.refresh(spark, path, spark.createDataFrame(same, SERIES + ", withdrawn boolean"), FIRST, LAST, N).count() == 0
    assert refresh.refresh(spark, path, spark.createDataFrame([], SERIES + ", withdrawn boolean"), FIRST, LAST, N).count() == 0
    assert mtimes(path, "filled") == before
    # all withdrawn: every table goes on without the day
    refresh.refresh(spark, path, spark.createDataFrame([(*r, True) for r in rows], SERIES + ", withdrawn boolean"), FIRST, LAST, N)
    assert refresh.filled_series(spark, path).where("value is not null").count() == 0 and refresh.filled_series(spark, path).count() == 640
    assert refresh._table(spark, path, "cells").count() == 0 and refresh._table(spark, path, "observations").count() == 0


# -- pyramid


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(61)
    values = {(b, y, x): float(rng.integers(-50, 50)) for b in "rg" for y in range(-5, 30) for x in range(40) if rng.random() < 0.7}
    frame = spark.createDataFrame([(*k, v) for k, v in values.items()] + [("r", 3, 3, None)], "band string, y int, x int, value double")
    return values, pyramid.build(frame, 4)


def test_levels_are_sums_of_the_cells_below(scene):
    values, built = scene
    got = {(r["level"], r["band"], r["y"], r["x"]): (r["total"], r["count"], r["least"], r["most"]) for r in built.collect()}
    want = {}
    for (b, y, x), v in values.items():
        for k in range(5):
            want.setdefault((k, b, y >> k, x >> k), []).append(v)
    assert got == {k: (sum(v), len(v), min(v), max(v)) for k, v in want.items()}


@pytest.mark.parametrize("box", [(0, 15, 0, 31), (1, 22, 3, 38), (-5, 29, 0, 39), (7, 7, 9, 9), (-3, 2, 5, 20), (100, 120, 0, 5), (-50, 90, -50, 90)])
def test_regions_are_exact_and_bounded(scene, box):
    values, built = scene
    own = {b: [v for (band, y, x), v in values.items() if band == b and box[0] <= y <= box[1] and box[2] <= x <= box[3]] for b in "rg"}
    want = {b: (len(v), sum(v), pytest.approx(sum(v) / len(v)), min(v), max(v)) for b, v in own.items() if v}
    assert {r["band"]: (r["n"], r["total"], r["mean"], r["least"], r["most"]) for r in pyramid.region(built, box).collect()} == want
    for level in range(5):
        for r in pyramid.region_at(built, box, level).collect():
            if own[r["band"]]:
                mean = np.mean(own[r["band"]])
                assert r["low"] - 1e-9 <= mean <= r["high"] + 1e-9
                if level == 0:
                    assert r["mean"] == r["low"] == r["high"] == pytest.approx(mean)


def test_an_empty_pyramid(spark):
    none = pyramid.build(spark.createDataFrame([], "band string, y int, x int, value double"), 2)
    assert none.count() == 0 and pyramid.region(none, (0, 9, 0, 9)).count() == 0 and pyramid.region_at(none, (0, 9, 0, 9), 1).count() == 0
    with pytest.raises(ValueError):
        pyramid.build(none.withColumn("value", F.col("total")), -1)
