"""Chains of operators: the five correction stages, report layers, the run record."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.correct import corrections, fill_tracker
from ..operators.focal import edge_blend


def stages(frames: DataFrame, mode: str = "reference", radius: float = 1.5) -> DataFrame:
    """band, y, x, broken, temporal, global, adaptive, blended, seg, tracker from frames (band, y, x, t0, t1, l, seg).

    The baseline falls back on the reference image; each stage fills the gaps of the target alone.
    """
    both = corrections(frames.withColumn("l", F.coalesce("l", "t1")), mode)
    patched = both.withColumn("raw", F.col("t0")).withColumn("patched", F.coalesce("t0", "seg_corrected"))
    out = edge_blend(patched, radius)
    return out.select(
        "band", "y", "x", F.col("t0").alias("broken"), F.coalesce("t0", "l").alias("temporal"), F.coalesce("t0", "scene_corrected").alias("global"), F.col("patched").alias("adaptive"), "blended", "seg",
        fill_tracker(F.col("t0"), F.coalesce("t0", "l")).alias("tracker"))


def report_layers(result: DataFrame, truth: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """The eleven analytical layers as columns; missing numbers take nodata, for export only. result is interpolate()'s, truth has band, y, x, truth, held for all bands.

    The signed error is of eligible cells alone: withheld, with truth in every band.
    """
    bands = F.count("*").over(Window.partitionBy("y", "x"))
    eligible = F.col("held") & (F.count("truth").over(Window.partitionBy("y", "x")) == bands)
    j = result.join(truth, ["band", "y", "x"], "left").withColumn("_eligible", eligible)
    put = lambda c: F.coalesce(c, F.lit(nodata))
    return j.select(
        "band", "y", "x", put(F.col("truth")).alias("truth"), put(F.col("observed")).alias("allowed"), put(F.col("prediction")).alias("prediction"), put(F.col("filled")).alias("filled"),
        put(F.when(F.col("_eligible"), F.col("prediction") - F.col("truth"))).alias("signed_error"), F.coalesce(F.col("held").cast("int"), F.lit(255)).alias("holdout"), F.col("support_count").alias("support"), "status",
        put(F.col("before_age_days")).alias("before_age"), put(F.col("after_age_days")).alias("after_age"), F.col("filled_origin").alias("origin"))


def write_layers(layers: DataFrame, path: str) -> None:
    layers.write.partitionBy("band").parquet(path)


def run_record(parameters: dict, reference_days: list[str], metrics: dict, sources: dict[str, bytes | str]) -> str:
    """A JSON record of a run; a missing number is null, never NaN. sources: a table's fingerprint as it is, or the bytes of a small file, whose digest is taken."""
    return json.dumps({"parameters": parameters, "reference_days": reference_days, "metrics": metrics, "sha256": {k: v if isinstance(v, str) else hashlib.sha256(v).hexdigest() for k, v in sources.items()}}, allow_nan=False, sort_keys=True)
