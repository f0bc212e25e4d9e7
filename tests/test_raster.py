"""Small cases of the raster operators, with results known beforehand."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave import catalog
from skyweave.functions import expr as X
from skyweave.operators import correct, focal, fusion, holdout, metrics, mosaic, resample, segment, temporal
from skyweave.plans import pipeline
from skyweave.sources import cubes

CELLS = "band string, y int, x int, d int, value double"


def nearest_two(series, target, window, carry):
    """What is predicted for a target day from (day, value) pairs, by a plain loop: value, ages, sides found, status."""
    before = after = None
    for day, value in series:
        if value is None or not np.isfinite(value) or day == target or abs(day - target) > window:
            continue
        if day < target and (before is None or day > before[0]):
            before = (day, value)
        if day > target and (after is None or day < after[0]):
            after = (day, value)
    ages = (before and float(target - before[0]), after and float(after[0] - target))
    sides = (before is not None) + (after is not None)
    if sides == 2:
        return before[1] + (after[1] - before[1]) * ages[0] / (ages[0] + ages[1]), *ages, sides, 1
    if carry and sides:
        return (before or after)[1], *ages, sides, 2 if before else 3
    return None, *ages, sides, 0


@pytest.mark.parametrize("carry", [False, True])
@pytest.mark.parametrize("window", [1, 9, 40])
def test_interpolation_against_a_loop(spark, carry, window):
    """Generated series around a turn of the year, given in any order: gaps, infinities, days at the window's edge, the target day itself."""
    rng = np.random.default_rng(100 + window + carry)
    target = (datetime.date(2019, 12, 30) - datetime.date(1970, 1, 1)).days
    series = {}
    for x in range(120):
        days = rng.choice(np.arange(target - 50, target + 51), rng.integers(0, 14), replace=False)
        series[x] = [(int(d), [None, float("nan"), float("inf"), 0.0, float(rng.normal())][rng.integers(0, 5)]) for d in days]
    series[120], series[121], series[122] = [(target - window, 2.0), (target + window, 5.0)], [(target - window - 1, 2.0), (target + window + 1, 5.0)], [(target, 7.0)]
    rows = [("b", 0, x, d, v) for x, own in series.items() for d, v in own]
    cells = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], CELLS).withColumn("value", X.finite(F.col("value")))
    observed = {x: (None if x % 3 else 0.25 * x) for x in series}
    aim = spark.createDataFrame([("b", 0, x, v) for x, v in observed.items()], "band string, y int, x int, observed double")
    out = temporal.interpolate(cells, aim, "2019-12-30", window, allow_one_sided=carry).collect()
    assert len(out) == len(series)
    for r in out:
        value, age_before, age_after, sides, status = nearest_two(series[r["x"]], target, window, carry)
        assert r["prediction"] == (value if value is None else pytest.approx(value, abs=1e-12))
        assert (r["before_age_days"], r["after_age_days"], r["support_count"], r["status"]) == (age_before, age_after, sides, status)
        own = observed[r["x"]]
        assert r["filled"] == (own if own is not None else r["prediction"]) and r["filled_origin"] == (1 if own is not None else status + 1 if status else 0)


def test_lines_in_time_come_back(spark):
    """On a straight line any two days give every day between them."""
    rng = np.random.default_rng(8)
    level, rise = rng.normal(size=25), rng.normal(size=25)
    line = lambda x, d: float(level[x] + rise[x] * (d - 18_250))
    cells = spark.createDataFrame([("b", 0, x, d, line(x, d)) for x in range(25) for d in (18_241, 18_249, 18_263)], CELLS)
    aim = spark.createDataFrame([("b", 0, x, None) for x in range(25)], "band string, y int, x int, observed double")
    for r in temporal.interpolate(cells, aim, 18_255, 20).collect():
        assert r["filled"] == pytest.approx(line(r["x"], 18_255), abs=1e-9) and r["status"] == 1


def test_arguments_are_checked(spark):
    for bad in (0, True, 1.5, -3, "7"):
        with pytest.raises(ValueError):
            X.checked_window(bad)
    for bad in ("2022-7-1", "20220701", "2022-02-30", None, "2022-07-01T00:00"):
        with pytest.raises(ValueError):
            X.checked_date(bad)
    with pytest.raises(ValueError):
        temporal.check_unique_days(spark.createDataFrame([("b", 0, 0, 1, 0.1), ("b", 0, 0, 1, 0.2)], CELLS))
    for call in (lambda: holdout.holdout(F.lit(1), F.lit(1), 3, 3, "moon"), lambda: correct.deltas(None, "other"), lambda: fusion.pair_weights(1, 1, 2), lambda: cubes.checked_manifest({"units": "dn"}), lambda: focal.focal(None, 1.5, "median")):
        with pytest.raises(ValueError):
            call()


def test_interpolation_checks_what_it_gets(spark):
    cells = spark.createDataFrame([("b", 0, 0, 100, 0.1, True, 1), ("b", 0, 0, 110, 0.2, True, 1)], CELLS + ", ok boolean, flag int")
    target = spark.createDataFrame([("b", 0, 0, None)], "band string, y int, x int, observed double")
    for bad in ({"when": "1970-4-16"}, {"max_distance": 0}, {"max_distance": True}, {"valid": "flag"}, {"valid": "absent"}, {"target": target.drop("observed")}, {"cells": cells.drop("value")}):
        with pytest.raises(ValueError):
            temporal.interpolate(**({"cells": cells, "target": target, "when": 105} | bad))
    assert temporal.interpolate(cells, target, "1970-04-16", valid="ok").first()["prediction"] == pytest.approx(0.15)
    assert temporal.interpolate(cells.withColumn("ok", F.col("d") < 105), target, 105, valid="ok").first()["prediction"] is None
    for distance in (5, 32, 700):
        twice = cells.union(cells.where("d = 110"))
        with pytest.raises(Exception, match="a day occurs twice in a series"):
            temporal.interpolate(twice, target, 105, distance).collect()
        assert temporal.interpolate(twice, target, 300, 20).first()["status"] == 0  # outside the window


def test_days_on_a_grid_come_from_one_pass(spark):
    rng = np.random.default_rng(4)
    rows = [("b", 0, x, d, float(rng.random())) for x in range(20) for d in range(90, 121) if rng.random() < 0.4]
    cells = spark.createDataFrame(rows, CELLS)
    grid = spark.createDataFrame([("b", 0, x) for x in range(22)], "band string, y int, x int")
    own = {(r[2], r[3]): r[4] for r in rows}
    one = {r["x"]: r for r in temporal.interpolate_on_grid(cells, grid, 105, 6, allow_one_sided=True, days={"late": 118}).collect()}
    target = grid.join(cells.where("d = 105").select("band", "y", "x", F.col("value").alias("observed")), ["band", "y", "x"], "left")
    for r in temporal.interpolate(cells, target, 105, 6, allow_one_sided=True).collect():
        assert all(one[r["x"]][k] == r[k] for k in ("observed", "prediction", "filled", "status", "support_count", "filled_origin"))
        assert one[r["x"]]["late"] == own.get((r["x"], 118))


def test_holdout_counts(spark):
    g = spark.range(167 * 167).select((F.col("id") % 167).cast("int").alias("x"), F.expr("cast(id div 167 as int)").alias("y"))
    for pattern, n in (("cloud", 6385), ("stripes", 8489), ("scene", 27889)):
        assert g.where(holdout.holdout(F.col("x"), F.col("y"), 167, 167, pattern)).count() == n


def test_layers_of_a_drifting_scene(spark):
    """A scene that brightens evenly is predicted exactly wherever two days are seen; cells that one side lacks stay missing in every layer."""
    rng = np.random.default_rng(21)
    days, lost = (18_700, 18_703, 18_712), {(2, 5), (9, 0), (10, 11)}
    start, rate = rng.uniform(0.05, 0.3, (3, 11, 13)), rng.uniform(0, 0.01, (3, 11, 13))
    rows = [(b, y, x, d, None if (y, x) in lost and d == days[2 - (x % 2) * 2] else float(start[i, y, x] + rate[i, y, x] * (d - days[0]))) for i, b in enumerate(cubes.BANDS) for y in range(11) for x in range(13) for d in days]
    cells = spark.createDataFrame(rows, CELLS)
    truth = cells.where(F.col("d") == days[1]).select("band", "y", "x", F.col("value").alias("truth"), F.lit(True).alias("held"))
    out = temporal.interpolate(cells, truth.select("band", "y", "x", F.lit(None).cast("double").alias("observed")), days[1])
    scored = truth.join(out.select("band", "y", "x", "prediction"), ["band", "y", "x"])
    assert tuple(metrics.coverage(scored, 3).first())[:3] == (143, 140, 3)
    assert all(r["rmse"] < 1e-13 for r in metrics.band_scores(scored, 3).collect())
    assert {(r["y"], r["x"]) for r in out.where("filled is null and status = 0").collect()} == lost
    layers = pipeline.report_layers(out, truth)
    assert layers.where("filled = -9999").count() == 9 and metrics.violations(out).first()[0] == 0


def test_scores_against_a_loop(spark):
    """Only withheld cells whose bands all have truth are eligible, of these only those whose bands are all predicted are scored."""
    rng = np.random.default_rng(22)
    some = lambda v, share: None if rng.random() < share else float(v)
    rows = [(b, y, x, some(rng.normal(), 0.1), some(rng.normal(), 0.1), bool((x + y) % 3)) for b in "abcd" for y in range(9) for x in range(12)]
    scored = spark.createDataFrame(rows, "band string, y int, x int, truth double, prediction double, held boolean")
    at = {}
    for b, y, x, t, p, h in rows:
        at.setdefault((y, x), []).append((b, t, p, h))
    eligible = [own for own in at.values() if own[0][3] and all(t is not None for _, t, _, _ in own)]
    whole = [own for own in eligible if all(p is not None for _, _, p, _ in own)]
    assert tuple(metrics.coverage(scored, 4).first()) == (len(eligible), len(whole), len(eligible) - len(whole), pytest.approx(len(whole) / len(eligible)))
    for r in metrics.band_scores(scored, 4).collect():
        t, p = np.array([(t, p) for own in whole for b, t, p, _ in own if b == r["band"]]).T
        assert r["rmse"] == pytest.approx(np.sqrt(np.mean((p - t) ** 2))) and r["mae"] == pytest.approx(np.mean(abs(p - t))) and r["bias"] == pytest.approx(np.mean(p - t))
        assert r["pearson_r"] == pytest.approx(np.corrcoef(t, p)[0, 1]) and r["r2"] == pytest.approx(1 - np.sum((p - t) ** 2) / np.sum((t - t.mean()) ** 2))
    flat = metrics.band_scores(scored.withColumn("truth", F.lit(0.5)), 4).first()
    assert flat["r2"] is None and flat["rmse"] is not None
    assert metrics.band_scores(scored.withColumn("prediction", F.lit(None).cast("double")), 4).first()["rmse"] is None


def test_fusion_identities(spark):
    row = spark.createDataFrame([(0.4, 0.3, 0.6, 0.35, 0.32)], "l1 double, m1 double, l2 double, m2 double, mt double")
    c = F.col
    fuse = lambda mt, w1, w2: row.select(fusion.dual_residual(c("l1"), c("m1"), c("l2"), c("m2"), mt, w1, w2)).first()[0]
    assert fuse(c("mt"), 7 / 15, 8 / 15) == pytest.approx(0.32 + (7 / 15) * 0.1 + (8 / 15) * 0.25)
    assert fuse(c("m1"), 1.0, 0.0) == pytest.approx(0.4) and fuse(c("m2"), 0.0, 1.0) == pytest.approx(0.6)
    assert fuse(F.lit(None).cast("double"), 0.5, 0.5) is None
    assert row.select(fusion.single_delta(c("l1"), c("m1"), c("m1"))).first()[0] == pytest.approx(0.4)


def test_both_correction_modes(spark):
    rows = [("b", 0, x, 0.2, 0.2, 0.2, 0) for x in range(40)] + [("b", 1, x, None, 0.6, 0.6, 0) for x in range(40)]
    frames = spark.createDataFrame(rows, "band string, y int, x int, t0 double, t1 double, l double, seg int")
    for mode, want in (("reference", 1.0), ("temporal_bias", 0.6)):
        for f in (correct.global_correction, correct.adaptive_correction):
            assert f(frames, mode).where("t0 is null").first()["corrected"] == pytest.approx(want)


def test_few_clear_cells_take_the_scene(spark):
    rows = [("b", 0, x, 1.0, 1.0, 0.5, 0) for x in range(40)] + [("b", 1, x, 5.0, 1.0, 0.5, 1) for x in range(29)]
    frames = spark.createDataFrame(rows, "band string, y int, x int, t0 double, t1 double, l double, seg int")
    d = {r["seg"]: r["delta"] for r in correct.segment_deltas(frames, "temporal_bias").collect()}
    assert d[0] == pytest.approx(0.5) and d[1] == pytest.approx((40 * 1 + 29 * 5) / 69 - 0.5)


def test_stages_keep_what_was_observed(spark):
    rows = [("b", y, x, None if (y + x) % 3 == 0 else 0.3, 0.3, 0.3, 0) for y in range(12) for x in range(12)]
    frames = spark.createDataFrame(rows, "band string, y int, x int, t0 double, t1 double, l double, seg int")
    for r in pipeline.stages(frames).collect():
        # an unchanged, constant scene stays as it is
        assert all(r[k] == pytest.approx(0.3) for k in ("temporal", "global", "adaptive", "blended"))


def test_expressions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    null = F.lit(None).cast("double")
    assert get(X.clip(null)) is None and get(X.clip(F.lit(3.0))) == 1.0 and get(X.clip(F.lit(3.0), high=None)) == 3.0
    assert get(X.normalized_difference(F.lit(1.0), F.lit(-1.0))) is None and get(X.normalized_difference(F.lit(1.0), F.lit(-1.0), 0.0)) == 0.0
    assert get(X.guarded_difference(F.lit(0.0), F.lit(0.0))) == 0.0
    assert len(X.circle_offsets(1.5)) == 9 and len(X.circle_offsets(5)) == 81 and len(X.circle_offsets(6)) == 113


def brute_focal(values, radius, how):
    offsets = X.circle_offsets(radius)
    out = {}
    for y, x in {(a + dy, b + dx) for a, b in values for dy, dx in offsets}:
        near = [values[y + dy, x + dx] for dy, dx in offsets if (y + dy, x + dx) in values]
        if near:
            out[y, x] = max(near) if how == "max" else sum(near) / len(near)
    return out


@pytest.mark.parametrize("radius", [1.0, 1.5, 2.3, 5.0, 6.0])
def test_circles_against_brute_force(spark, radius):
    rng = np.random.default_rng(3)
    values = {(y, x): float(rng.normal()) for y in range(14) for x in range(17) if rng.random() < 0.15}
    cells = spark.createDataFrame([("b", y, x, v) for (y, x), v in values.items()] + [("b", 0, 40, None)], "band string, y int, x int, value double")
    for how in ("avg", "max"):
        got = {(r["y"], r["x"]): r["focal"] for r in focal.focal(cells, radius, how).collect()}
        want = brute_focal(values, radius, how)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    dense = spark.createDataFrame([("b", y, x, values.get((y, x))) for y in range(14) for x in range(17)], "band string, y int, x int, value double")
    want = brute_focal(values, radius, "avg")
    for r in focal.focal_on_grid(dense, radius, "value").collect():
        assert r["focal"] == pytest.approx(want.get((r["y"], r["x"])), abs=1e-12)


def test_bilinear_against_brute_force(spark):
    rng = np.random.default_rng(9)
    values = {(y, x): float(rng.normal()) for y in range(4) for x in range(5) if rng.random() < 0.85}
    coarse = spark.createDataFrame([("b", y, x, v) for (y, x), v in values.items()], "band string, cy int, cx int, value double")
    fine = spark.createDataFrame([("b", y, x) for y in range(20) for x in range(25)], "band string, y int, x int")
    my, mx = 3, 4
    for r in resample.bilinear(coarse, fine, 5, (4, 5)).collect():
        gy, gx = (r["y"] + 0.5) / 5 - 0.5, (r["x"] + 0.5) / 5 - 0.5
        four = [((gy - np.floor(gy) if dy else 1 - gy + np.floor(gy)) * (gx - np.floor(gx) if dx else 1 - gx + np.floor(gx)), values.get((min(my, max(0, int(np.floor(gy)) + dy)), min(mx, max(0, int(np.floor(gx)) + dx))))) for dy in (0, 1) for dx in (0, 1)]
        assert r["value"] == (None if any(v is None for _, v in four) else pytest.approx(sum(w * v for w, v in four)))


def test_bilinear_keeps_a_plane(spark):
    coarse = spark.createDataFrame([("b", y, x, float(y + 2 * x)) for y in range(4) for x in range(4)], "band string, cy int, cx int, value double")
    fine = spark.createDataFrame([("b", y, x) for y in range(5, 15) for x in range(5, 15)], "band string, y int, x int")
    for r in resample.bilinear(coarse, fine, 5, (4, 4)).collect():
        assert r["value"] == pytest.approx((r["y"] + 0.5) / 5 - 0.5 + 2 * ((r["x"] + 0.5) / 5 - 0.5))


def test_feather_does_not_leak(spark):
    rows = [("b", y, x, None if x > 2 else 0.2, 0.7) for y in range(6) for x in range(6)]
    out = focal.feather(spark.createDataFrame(rows, "band string, y int, x int, raw double, patched double"))
    assert all(r["feathered"] == 0.7 for r in out.where("x > 2").collect())


def test_cube_round_trip(spark, tmp_path):
    manifest = {"units": cubes.UNITS, "bands": list(cubes.BANDS), "target_date": "2022-07-01", "crs": "EPSG:32616", **cubes.chip_grid(730_011.0, 4_638_444.0, 480)}
    cells = spark.createDataFrame([(datetime.date(2022, 7, 1), "SR_B5", 0, 0, 0.5)], "day date, band string, y int, x int, value double")
    cubes.write_cube(cells, str(tmp_path / "cube"), manifest)
    back, read = cubes.read_cube(spark, str(tmp_path / "cube"))
    assert read == manifest | {"qa_clear_fraction_by_date": {"2022-07-01": 0.0}} and back.select("day", "band", "y", "x", "value").collect() == cells.collect()
    assert cubes.snapped(31.0, 89.0) == (30.0, 90.0, 2)
    record = json.loads(pipeline.run_record({"window": 5}, ["2022-07-01"], {"rmse": None}, {"cube": b"x"}))
    assert len(record["sha256"]["cube"]) == 64
    with pytest.raises(ValueError):
        pipeline.run_record({}, [], {"rmse": float("nan")}, {})
    for bad in ({"crs": "EPSG:4326"}, {"crs": "Michigan"}, {"transform": [30, 0, 5, 0, -30, 90]}, {"transform": [30, 1, 30, 0, -30, 90]}, {"target_date": "2022-7-1"}, {"width": 9}, {"height": 513}, {"bands": ["SR_B4"]}):
        with pytest.raises(ValueError):
            cubes.checked_manifest(manifest | bad)
    for bad in (cells.withColumn("y", F.lit(16)), cells.withColumn("x", F.lit(-1)), cells.withColumn("band", F.lit("SR_B2")), cells.withColumn("day", F.lit("2022-07-02").cast("date"))):
        with pytest.raises(ValueError):
            cubes.write_cube(bad, str(tmp_path / "bad"), manifest)


def test_chip_grid_lies_on_whole_steps():
    g = cubes.chip_grid(730_011.0, 4_638_444.0, 5000)
    assert g["width"] == g["height"] == 167 and g["transform"] == [30, 0, 727_500, 0, -30, 4_640_970]


def test_clear_fractions(spark):
    manifest = {"bands": ["a", "b"], "width": 2, "height": 2}
    day = datetime.date(2022, 7, 1)
    cells = spark.createDataFrame([(day, "a", 0, 0, 1.0), (day, "b", 0, 0, 1.0), (day, "a", 0, 1, 1.0), (day, "b", 0, 1, None)], "day date, band string, y int, x int, value double")
    assert cubes.clear_fractions(cells, manifest) == {"2022-07-01": 0.25}


def test_layers_are_written_and_read(spark, tmp_path):
    cells = spark.createDataFrame([("b", 0, x, d, 0.1 * x) for x in range(4) for d in (100, 110)], CELLS)
    target = spark.createDataFrame([("b", 0, x, None if x else 0.7) for x in range(4)], "band string, y int, x int, observed double")
    truth = target.select("band", "y", "x", F.lit(0.5).alias("truth"), (F.col("x") > 1).alias("held"))
    layers = pipeline.report_layers(temporal.interpolate(cells, target, 105), truth)
    pipeline.write_layers(layers, str(tmp_path / "layers"))
    back = spark.read.parquet(str(tmp_path / "layers"))
    assert sorted(back.select(*layers.columns).collect()) == sorted(layers.collect()) and len(layers.columns) == 14
    stages = pipeline.stages(spark.createDataFrame([("b", 0, x, None if x else 0.3, 0.2, 0.2, 0) for x in range(4)], "band string, y int, x int, t0 double, t1 double, l double, seg int"))
    pipeline.write_layers(stages, str(tmp_path / "stages"))
    assert spark.read.parquet(str(tmp_path / "stages")).where("broken is null").count() == 3


def test_signed_errors_are_of_eligible_cells(spark):
    cells = spark.createDataFrame([(b, 0, x, d, 0.5) for b in "ab" for x in range(4) for d in (100, 110)], CELLS)
    truth = spark.createDataFrame([(b, 0, x, None if (b, x) == ("b", 1) else 0.25, x < 3) for b in "ab" for x in range(4)], "band string, y int, x int, truth double, held boolean")
    result = temporal.interpolate(cells, truth.select("band", "y", "x", F.lit(None).cast("double").alias("observed")), 105)
    errors = {(r["band"], r["x"]): r["signed_error"] for r in pipeline.report_layers(result, truth).collect()}
    assert errors == {(b, x): 0.25 if x in (0, 2) else -9999.0 for b in "ab" for x in range(4)}


def test_bands_share_a_mask(spark):
    rows = [("A", 1, 0, 0, "v", 10.0, 0, 0), ("A", 1, 0, 0, "c", 20.0, 0, 0), ("A", 1, 0, 1, "v", 10.0, 0, 0), ("A", 1, 0, 1, "c", 20.0, 8, 0), ("A", 1, 0, 2, "v", 10.0, 0, 1), ("A", 1, 0, 2, "c", 20.0, 0, 0), ("B", 1, 0, 3, "v", None, 0, 0), ("B", 1, 0, 3, "c", 1.0, 0, 0), ("B", 1, 0, 4, "v", -9000.0, 64, 0), ("B", 1, 0, 4, "c", 1.0, 0, 0), ("B", 1, 0, 4, "x", 1.0, 1, 1)]
    frame = spark.createDataFrame(rows, "sensor string, d int, y int, x int, band string, dn double, qa int, radsat int")
    got = {(r["sensor"], r["x"], r["band"]): r["value"] for r in mosaic.prepared(frame, ("v", "c")).collect()}
    assert got.keys() == {("A", 0, "v"), ("A", 0, "c"), ("B", 4, "v"), ("B", 4, "c")} and got["B", 4, "v"] < -0.4


def test_passes_keep_their_clouds(spark):
    clear = spark.createDataFrame([("b", 0, 0, d, 1.0 + d) for d in (0, 2, 8)] + [("b", 0, 1, 0, 5.0)], CELLS)
    passes = clear.union(spark.createDataFrame([("b", 0, 0, 5, 99.0), ("b", 0, 1, 3, 7.0), ("b", 0, 2, 3, 1.0)], CELLS))
    got = {(r["x"], r["d"]): (r["raw"], r["imputed"], r["patched"]) for r in temporal.pass_frames(passes, clear, 0).collect()}
    assert got[0, 5] == (99.0, pytest.approx(6.0), pytest.approx(6.0)) and got[0, 2] == (3.0, pytest.approx(3.0), 3.0)
    assert got[1, 3] == (7.0, None, None) and got[2, 3] == (1.0, None, None) and got[1, 0] == (5.0, None, 5.0)


def test_segments_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0.1, 0.2], [0.5, 0.5], [0.9, 0.1], [0.4, 0.9]])
    rows = [(i // 40, i % 40, *(float(v) for v in centres[rng.integers(4)] + 0.03 * rng.normal(size=2))) for i in range(1200)] + [(99, 0, None, 0.3)]
    pixels = spark.createDataFrame(rows, "y int, x int, a double, b double")
    runs = [{(r["y"], r["x"]): r["seg"] for r in segment.kmeans_segments(pixels.repartition(n), ["a", "b"], n=600).collect()} for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 1200 and set(runs[0].values()) == {0, 1, 2, 3}
    points = {(y, x): np.array([a, b]) for y, x, a, b in rows if a is not None}
    mean = [np.mean([points[k] for k, s in runs[0].items() if s == i], axis=0) for i in range(4)]
    # labels are in order of the centres, and every pixel is of the nearest one
    assert [tuple(m) for m in mean] == sorted(tuple(m) for m in mean)
    scale = np.std([p for p in points.values()], axis=0)
    assert all(s == int(np.argmin([np.sum(((points[k] - m) / scale) ** 2) for m in mean])) for k, s in runs[0].items())


def test_fixed_start_segments_against_a_loop(spark):
    rng = np.random.default_rng(23)
    points = np.concatenate([rng.normal(m, 0.3, (150, 2)) for m in ((0, 0), (3, 1), (-2, 4))])
    rows = [(i // 25, i % 25, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(99, 0, None, 1.0)]
    frame = spark.createDataFrame(rows, "y int, x int, a double, b double")
    z = (points - points.mean(axis=0)) / points.std(axis=0)
    order = sorted(range(450), key=lambda i: (z[i].sum(), rows[i][0], rows[i][1]))
    centres = z[[order[(2 * i + 1) * 450 // 6] for i in range(3)]]
    for _ in range(10):
        own = ((z[:, None] - centres[None]) ** 2).sum(-1).argmin(axis=1)
        centres = np.array([z[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(3)])
    centres = np.array(sorted(map(tuple, centres)))
    want = ((z[:, None] - centres[None]) ** 2).sum(-1).argmin(axis=1)
    for parts in (1, 7):
        got = {(r["y"], r["x"]): r["seg"] for r in segment.lloyd_segments(frame.repartition(parts), ["a", "b"], k=3).collect()}
        assert got == {rows[i][:2]: int(want[i]) for i in range(450)}
    assert segment.lloyd_segments(frame.where("y = 99"), ["a", "b"]).count() == 0
    assert {r["seg"] for r in segment.lloyd_segments(frame.where("y = 0 and x < 2"), ["a", "b"]).collect()} == {0, 1}


def test_sampling_is_repeatable(spark):
    cells = spark.range(900).select((F.col("id") % 30).cast("int").alias("y"), F.expr("cast(id div 30 as int)").alias("x"))
    runs = [sorted((r["y"], r["x"]) for r in segment.sample_pixels(cells.repartition(n), 50).collect()) for n in (1, 5, 13)]
    assert runs[0] == runs[1] == runs[2] and len(set(runs[0])) == 50 and len({y for y, _ in runs[0]}) > 15


def test_same_date_gives_the_fine_image_back(spark):
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b)) for a, b in rng.uniform(0.01, 0.99, (50, 2))]
    for r in spark.createDataFrame(rows, "l double, m double").select("l", fusion.single_residual(F.col("l"), F.col("m"), F.col("m")).alias("f"), fusion.dual_residual(F.col("l"), F.col("m"), F.col("l"), F.col("m"), F.col("m"), 0.3, 0.7).alias("g")).collect():
        assert r["f"] == pytest.approx(r["l"]) and r["g"] == pytest.approx(r["l"])


def test_window_fusion_follows_its_rules(spark):
    rules = spark.createDataFrame([("n", 0, x, 2.0, 0.1) for x in range(3)] + [("r", 0, x, 1.0, 0.0) for x in range(3)], "band string, y int, x int, alpha double, beta double")
    coarse = spark.createDataFrame([(b, 0, x, d, 0.1 * (x + d)) for b in "nr" for x in range(3) for d in (1, 2)], "band string, y int, x int, d int, value double")
    for r in fusion.fused_index(fusion.window_fusion(rules, coarse), "n", "r", ["d", "y", "x"]).collect():
        m = 0.1 * (r["x"] + r["d"])
        assert r["ndvi"] == pytest.approx((2 * m + 0.1 - m) / (2 * m + 0.1 + m))


def test_results_are_compared_with_a_tolerance(spark):
    a = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.1), (4, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 0.5 + 1e-12), (2, 0.3), (3, 0.2), (5, 1.0)], "k int, v double")
    assert sorted(r["k"] for r in metrics.compare(a, b, ["k"], "v", 1e-10).collect()) == [2, 3, 4, 5]


def test_days_that_are_needed_are_read_alone(spark, small, capsys):
    catalog.Events(spark, small).filled(True).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan
    catalog.Parts(spark, small).frames.explain("formatted")
    assert "GreaterThanOrEqual(l_shipdate," in capsys.readouterr().out
    pipeline.stages(catalog.Parts(spark, small).frames).explain("formatted")
    assert capsys.readouterr().out.split("===== Subqueries")[0].count("Location:") <= 6
