"""Scores against withheld truth; no other module sees it. Input: band, y, x, truth, prediction, held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_eligibility(scored: DataFrame, bands: int) -> DataFrame:
    """eligible: held and true in all bands; scored: eligible and predicted in all bands. An absent band row counts as missing."""
    over = Window.partitionBy("y", "x")
    eligible = F.col("held") & (F.count("truth").over(over) == bands)
    return scored.withColumn("eligible", eligible).withColumn("scored", eligible & (F.count("prediction").over(over) == bands))


def coverage(scored: DataFrame, bands: int) -> DataFrame:
    e, s = F.count_if(F.col("eligible")) / bands, F.count_if(F.col("scored")) / bands
    out = with_eligibility(scored, bands).agg(e.cast("long").alias("eligible_pixels"), s.cast("long").alias("scored_pixels"))
    return out.withColumn("unresolved_pixels", F.col("eligible_pixels") - F.col("scored_pixels")).withColumn("coverage_fraction", F.when(F.col("eligible_pixels") > 0, F.col("scored_pixels") / F.col("eligible_pixels")))


def _fit(p: Column, t: Column) -> list[Column]:
    error = p - t
    n, varies_t = F.count(error), F.min(t) < F.max(t)
    r = F.when((n > 1) & varies_t & (F.min(p) < F.max(p)), F.covar_pop(p, t) / (F.sqrt(F.var_pop(p)) * F.sqrt(F.var_pop(t))))
    r2 = F.when((n > 0) & varies_t, 1 - F.sum(error * error) / (n * F.var_pop(t)))
    return [F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"), r.alias("pearson_r"), r2.alias("r2")]


def band_scores(scored: DataFrame, bands: int) -> DataFrame:
    """rmse, mae, bias, pearson_r, r2 of each band over the scored cells; null where there is none or nothing varies."""
    rows = with_eligibility(scored, bands)
    on = lambda c: F.when(F.col("scored"), F.col(c))
    return rows.groupBy("band").agg(*_fit(on("prediction"), on("truth")))


def benchmark(scored: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Of the pairs with a positive truth: n, rmse, mae, squared correlation, and the error saved against a baseline in percent."""
    pairs = scored.where("truth > 0 and prediction is not null")
    error, other = F.col("prediction") - F.col("truth"), F.col(baseline) - F.col("truth")
    g = pairs.groupBy("band").agg(F.count("*").alias("n"), *_fit(F.col("prediction"), F.col("truth")), F.sqrt(F.avg(F.when(other.isNotNull(), error * error))).alias("_own"), F.sqrt(F.avg(other * other)).alias("_base"))
    saved = F.when(F.col("_base") > 0, 100 * (F.col("_base") - F.col("_own")) / F.col("_base"))
    return g.select("band", "n", "rmse", "mae", (F.col("pearson_r") * F.col("pearson_r")).alias("r_squared"), saved.alias("reduction_percent"))


def stage_metrics(stages: DataFrame, names: list[str]) -> DataFrame:
    """rmse and mae of each stage inside the gap, and the improvement on the first in percent. stages: band, truth, held and the stages' columns."""
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(k).alias("v")) for k in names]))
    long = stages.where("held").select("band", "truth", parts.alias("s")).select("band", "s.stage", (F.col("s.v") - F.col("truth")).alias("e"))
    g = long.groupBy("band", "stage").agg(F.count("e").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"))
    first = F.max(F.when(F.col("stage") == names[0], F.col("rmse"))).over(Window.partitionBy("band"))  # of a row for each stage
    return g.withColumn("_first", first).withColumn("improvement_percent", F.when(F.col("_first") > 0, 100 * (F.col("_first") - F.col("rmse")) / F.col("_first"))).drop("_first")


def violations(filled: DataFrame) -> DataFrame:
    """How many observed cells a fill has changed; none may be."""
    return filled.agg(F.count_if(F.col("observed").isNotNull() & ~F.col("observed").eqNullSafe(F.col("filled"))).alias("violations"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Rows of two results that differ by more than a tolerance or of which one is missing."""
    j = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full")
    return j.where((F.col("a").isNull() != F.col("b").isNull()) | (F.abs(F.col("a") - F.col("b")) > tolerance))
