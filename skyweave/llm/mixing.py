"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, many_buckets, ranked, stored, uniform, whole_row, words_of

#: A source's quality weights are summed up in so many steps of the range from 0 to 1.
STEPS = 20
#: Sources up to which their plan is broadcast, and rows of their bucket sums up to which these are; above, the joins shuffle.
BROADCAST_SOURCES, BROADCAST_ROWS = 262_144, 262_144


def targets(sizes: list[tuple[str | None, int]], weights: Sequence[float], most_epochs: float = 3.0) -> dict[str | None, float]:
    """Words to take from each source: 100 % of all words shared by weight, none above most_epochs times its own.

    Sources by code point, null last, take the weights in turn. What a source at its limit can't use is shared
    anew among the others by weight, until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: most_epochs * n for s, n in order}
    out: dict[str | None, float] = {}
    left, free = float(sum(n for _, n in order)), [s for s, _ in order]
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > limit[s]]
        if not over:
            return out | {s: left * weight[s] / whole for s in free}
        out |= {s: limit[s] for s in over}
        left -= sum(limit[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def quality_weight(words: Column) -> Column:
    """A document's weight, 0.1 to 1: its share of distinct words, but a tenth where its words are of no usual length."""
    n = F.size(words)
    length = F.length(F.array_join(words, "")) / n
    return F.when(n == 0, 0.1).when(length.between(2.0, 12.0), F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.size(F.array_distinct(words)) / F.least(n, F.lit(400))))).otherwise(0.1)


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs (with no columns of these names) with _size, _quality and _at: what orders a source's documents, the exponential key first."""
    row = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("size"), quality_weight(w).alias("quality")))
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    at = F.struct((-F.log(uniform(own, str(seed))) / F.col("_row.quality")).alias("key"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    return docs.withColumn("_row", row).withColumn("_size", F.col("_row.size")).withColumn("_quality", F.col("_row.quality")).withColumn("_at", at).drop("_row")


def _bucket(weights: Column, buckets: int) -> Column:
    """The bucket of a key among evenly filled ones: how likely a key below it is, given how many of its source's documents have which weight."""
    likely = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w["share"] * (1 - F.exp(-w["weight"] * F.col("_at.key"))))
    return F.floor(likely * buckets)


def _plan(slim: DataFrame, weights: Sequence[float], most_epochs: float) -> DataFrame:
    """One row for each source: source_size, target, epochs, and _last, the place of the last document of the part epoch."""
    spark = slim.sparkSession
    steps = slim.groupBy("source", F.floor(F.col("_quality") * STEPS).alias("_step")).agg(F.sum("_size").alias("n"), F.count("*").alias("rows"), F.sum("_quality").alias("weight"))
    counts = steps.groupBy("source").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.collect_list(F.struct("rows", "weight")).alias("weights")).collect()
    sizes = [(r["source"], r["n"]) for r in counts]
    wanted = targets(sizes, weights, most_epochs)
    sent = F.broadcast if len(sizes) <= BROADCAST_SOURCES else lambda df: df
    shares = [[(w["rows"] / r["rows"], w["weight"] / w["rows"]) for w in sorted(r["weights"], key=lambda w: w["weight"] / w["rows"])] for r in counts]
    table = spark.createDataFrame([(s, n, wanted[s], int(wanted[s] // n) if n else 0, w) for (s, n), w in zip(sizes, shares)], "_source string, source_size long, target double, epochs int, _weights array<struct<share:double,weight:double>>")
    buckets = many_buckets(max((r["rows"] for r in counts), default=0))
    # rows alike are one row here, with the words of all: they are taken together
    alike = slim.groupBy("source", "_at", "_size").agg((F.count("*") * F.col("_size")).alias("_words"))
    same = alike["source"].eqNullSafe(table["_source"])
    own = alike.join(sent(table), same).withColumn("_bucket", _bucket(F.col("_weights"), buckets)).drop("_weights")
    placed = ranked(stored(own, "keys"), ["source"], ["_at"], F.col("_bucket"), "_before", F.col("_words"), len(sizes) * buckets <= BROADCAST_ROWS)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    taken = (F.col("_size") > 0) & (rest - F.col("_before") > F.col("_size") / 2)
    return sent(stored(placed.groupBy("_source", "source_size", "target", "epochs").agg(F.max(F.when(taken, F.col("_at"))).alias("_last")), "plan"))


def _taken(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    more = (F.col("_size") > 0) & F.coalesce(F.col("_at") <= F.col("_last"), F.lit(False))
    return keyed.join(plan, keyed["source"].eqNullSafe(plan["_source"])).withColumn("_copies", F.col("epochs") + more.cast("int"))


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), seed: int = 0, most_epochs: float = 3.0) -> DataFrame:
    """For every row of docs: doc_id, source, size (words), source_size, target, copies, taken (copies * size).

    A target of e.f source sizes is e complete epochs, then documents in order of their exponential keys -ln(u) / quality
    weight, u from a digest of doc_id and seed, whose sizes' prefix sums stay within the rest; the document across
    the end is taken if that comes nearer. Whole documents only, so a source misses its target by half a document at most.
    Null and empty texts have size 0 and no part in the part epoch. A null source is a source of its own. Rows alike in
    doc_id and text are taken together. An empty table gives an empty result. Extra columns are not read.
    A row for each source, its name and two numbers, goes to the driver: 100 MB for a million sources.
    """
    slim = stored(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix")
    out = _taken(slim, _plan(slim, weights, most_epochs))
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), seed: int = 0, most_epochs: float = 3.0) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, with docs' columns, whatever their names, and nothing else.

    Only the sources' plan meets the documents again, so texts are not shuffled. A document of no words comes once.
    """
    slim = stored(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix")
    out = _taken(_keyed(docs.select(whole_row(docs).alias("_whole"), "doc_id", "source", "text"), seed), _plan(slim, weights, most_epochs))
    times = F.when(F.col("_size") == 0, 1).otherwise(F.col("_copies"))
    return out.select("_whole", times.alias("_times")).where("_times > 0").select("_whole", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_time")).select("_whole.*")
