"""Bias correction of a temporal baseline: scene-wide, by segment, and older forms.

Columns: t0 target (missing in the gap), t1 reference image, l baseline, seg segment, all by band.
mode 'reference' adds the spatial term of the reference image; 'temporal_bias' leaves it out. With clear 0.2 and gap 0.6 in baseline and reference
the first gives 1.0: it counts the difference twice. Both are kept; neither is claimed to be right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("reference", "temporal_bias")


def _clear(c: str) -> Column:
    return F.avg(F.when(F.col("t0").isNotNull(), F.col(c)))


def _gap(c: str) -> Column:
    return F.avg(F.when(F.col("t0").isNull(), F.col(c)))


def _means(frames: DataFrame, *keys: str) -> DataFrame:
    """All means of a group in one pass."""
    return frames.groupBy(*keys).agg(_clear("t0").alias("mt"), _clear("l").alias("ml"), _gap("t1").alias("mg"), _clear("t1").alias("mc"), F.count("t0").alias("n"))


def _checked(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")


def deltas(frames: DataFrame, mode: str = "reference", least_clear: int = 30) -> DataFrame:
    """band, seg, delta, own_delta: what the scene and what the segment adds to the baseline, from one pass over frames.

    The scene's statistics are the sums of its segments', so cells without a segment (a row of seg null) count too. Scene: missing means count as 0, the spatial
    part only where both exist. Segment: its own bias if both means exist and enough of it is clear, else the scene's; its spatial part if both exist, else the scene's unguarded one.
    """
    _checked(mode)
    clear, gap = F.col("t0").isNotNull(), F.col("t0").isNull()
    of = {"t": F.col("t0"), "l": F.when(clear, F.col("l")), "g": F.when(gap, F.col("t1")), "c": F.when(clear, F.col("t1"))}
    sums = frames.groupBy("band", "seg").agg(*[f(c).alias(f"{f.__name__[0]}{k}") for k, c in of.items() for f in (F.sum, F.count)])
    scene = Window.partitionBy("band")  # over a row for each segment
    own = {k: F.try_divide(F.col(f"s{k}"), F.col(f"c{k}")) for k in of}
    whole = {k: F.try_divide(F.sum(f"s{k}").over(scene), F.sum(f"c{k}").over(scene)) for k in of}
    means = sums.select("band", "seg", F.col("ct").alias("n"), *[c.alias(k) for k, c in own.items()], *[c.alias(f"g{k}") for k, c in whole.items()])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    col = F.col
    g_temporal = zero(col("gt")) - zero(col("gl"))
    use = mode == "reference"
    g_spatial = F.coalesce(col("gg") - col("gc"), F.lit(0.0)) if use else F.lit(0.0)
    spatial = F.coalesce(col("g") - col("c"), zero(col("gg")) - zero(col("gc"))) if use else F.lit(0.0)
    temporal = F.coalesce(F.when(col("n") >= least_clear, col("t") - col("l")), g_temporal)
    return means.select("band", "seg", (g_temporal + g_spatial).alias("delta"), F.when(col("seg").isNotNull(), temporal + spatial).alias("own_delta"))


def corrections(frames: DataFrame, mode: str = "reference", least_clear: int = 30) -> DataFrame:
    """frames with `scene_corrected` and `seg_corrected`: l + the scene's and l + the segment's delta; a cell without a segment has no second one. One pass for the deltas, one join."""
    d = deltas(frames, mode, least_clear).withColumnsRenamed({"band": "_band", "seg": "_seg"})
    j = frames.join(d, (frames["band"] == d["_band"]) & frames["seg"].eqNullSafe(d["_seg"]), "left")
    return j.select(*frames.columns, (F.col("l") + F.col("delta")).alias("scene_corrected"), (F.col("l") + F.col("own_delta")).alias("seg_corrected"))


def global_correction(frames: DataFrame, mode: str = "reference") -> DataFrame:
    """frames with `corrected` = l + the scene's delta."""
    return corrections(frames, mode).drop("seg_corrected").withColumnRenamed("scene_corrected", "corrected")


def segment_deltas(frames: DataFrame, mode: str = "reference", least_clear: int = 30) -> DataFrame:
    """band, seg, delta of the segments."""
    return deltas(frames, mode, least_clear).where("seg is not null").select("band", "seg", F.col("own_delta").alias("delta"))


def adaptive_correction(frames: DataFrame, mode: str = "reference", least_clear: int = 30) -> DataFrame:
    """frames with `corrected` = l + the segment's delta; a cell without a segment stays missing."""
    return corrections(frames, mode, least_clear).drop("scene_corrected").withColumnRenamed("seg_corrected", "corrected")


def ring_adaptive(frames: DataFrame, ring: Column) -> DataFrame:
    """Segment biases of the cells in a ring around the gap; a missing baseline mean counts as 0, an unlisted segment's delta is 0."""
    near = frames.where(ring & F.col("t0").isNotNull())
    deltas = near.groupBy("band", "seg").agg((F.avg("t0") - F.coalesce(F.avg("l"), F.lit(0.0))).alias("delta"))
    return frames.join(deltas, ["band", "seg"], "left").withColumn("corrected", F.col("l") + F.coalesce("delta", F.lit(0.0))).drop("delta")


def texture_heuristic(frames: DataFrame, share: float = 0.35, least_clear: int = 100) -> DataFrame:
    """l + bias + share * (t1 - its clear mean) into [0, 1], if more than least_clear cells are clear; else l."""
    m = _means(frames, "band")
    j = frames.join(F.broadcast(m), "band")
    v = F.when(F.col("n") > least_clear, F.col("l") + (F.col("mt") - F.col("ml")) + share * (F.col("t1") - F.col("mc"))).otherwise(F.col("l"))
    return j.withColumn("corrected", F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))).drop("mt", "ml", "mg", "mc", "n")


def legacy_spatial_delta(frames: DataFrame) -> DataFrame:
    """l + the reference's gap mean minus clear mean of the segment, 0 where either is missing."""
    d = frames.groupBy("band", "seg").agg((_gap("t1") - _clear("t1")).alias("delta"))
    return frames.join(d, ["band", "seg"], "left").withColumn("corrected", F.col("l") + F.coalesce("delta", F.lit(0.0))).drop("delta")


def fill_tracker(raw: Column, temporal: Column) -> Column:
    """0 original, 1 temporal, 2 spatial."""
    return F.when(raw.isNotNull(), 0).when(temporal.isNotNull(), 1).otherwise(2)
