"""Segments of a reference image by K-means on a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def sample_pixels(cells: DataFrame, n: int = 5000) -> DataFrame:
    """The n cells of the smallest digests of their place: the same for any partitioning, and in any engine."""
    return cells.orderBy(F.md5(F.concat_ws(":", "y", "x").cast("binary")), "y", "x").limit(n)


def kmeans_segments(pixels: DataFrame, bands: list[str], k: int = 4, n: int = 5000, seed: int = 0) -> DataFrame:
    """y, x, seg for the cells all of whose bands are valid; labels are sorted by the centres, so that reruns agree."""
    valid = pixels.dropna(subset=bands)
    joined = VectorAssembler(inputCols=bands, outputCol="_raw").transform(valid)
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(joined)
    scaled = scaler.transform(joined)
    model = KMeans(k=k, seed=seed).fit(sample_pixels(scaled, n))
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))
    label = F.element_at(F.array(*[F.lit(order.index(i)) for i in range(len(order))]), F.col("prediction") + 1)
    return model.transform(scaled).select("y", "x", label.alias("seg"))


def _nearest(features: list[Column], centres: list[tuple[float, ...]]) -> Column:
    """The number of the nearest centre, the smaller of numbers as near."""
    far = lambda c: sum(((f - F.lit(v)) * (f - F.lit(v)) for f, v in zip(features[1:], c[1:])), (features[0] - F.lit(c[0])) * (features[0] - F.lit(c[0])))
    return F.array_min(F.array(*[F.struct(far(c).alias("far"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]


def lloyd_segments(pixels: DataFrame, bands: list[str], k: int = 4, n: int = 5000, rounds: int = 10) -> DataFrame:
    """y, x, seg as kmeans_segments(), from a start that depends on the values alone: the same in any engine.

    Bands are taken to mean 0 and deviation 1 over all valid cells; the centres are fitted on the n cells of the smallest digests, starting at the middles of k
    equal parts of these by the sum of their bands (ties by place), in `rounds` rounds of assignment and mean; a centre without a cell stays. Labels follow the
    centres' order. Fewer cells than k give fewer centres, none give no rows. k centres go to the driver each round, and back as literals.
    """
    valid = pixels.dropna(subset=bands)
    of = valid.agg(*[f(b).alias(f"{f.__name__}{i}") for i, b in enumerate(bands) for f in (F.avg, F.stddev_pop)]).first()
    scale = [((of[f"avg{i}"] or 0.0), (of[f"stddev_pop{i}"] or 1.0)) for i in range(len(bands))]
    features = [((F.col(b) - F.lit(m)) / F.lit(s)) for b, (m, s) in zip(bands, scale)]
    names = [f"_f{i}" for i in range(len(bands))]
    sample = stored(sample_pixels(valid, n).select("y", "x", *[f.alias(c) for f, c in zip(features, names)]), "sample")
    m = sample.count()
    k = min(k, m)
    if not k:
        return valid.select("y", "x", F.lit(None).cast("int").alias("seg"))
    wanted = [(2 * i + 1) * m // (2 * k) for i in range(k)]
    ordered = sample.orderBy(sum((F.col(c) for c in names[1:]), F.col(names[0])), "y", "x").select(*names).collect()  # n rows at most
    centres = [tuple(ordered[i]) for i in wanted]
    for _ in range(rounds):
        own = sample.groupBy(_nearest([F.col(c) for c in names], centres).alias("i")).agg(*[F.avg(c).alias(c) for c in names]).collect()
        moved = {r["i"]: tuple(r[c] for c in names) for r in own}
        centres = [moved.get(i, c) for i, c in enumerate(centres)]
    return valid.select("y", "x", _nearest(features, sorted(centres)).alias("seg"))
