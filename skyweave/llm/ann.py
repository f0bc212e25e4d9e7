"""Approximate nearest neighbours by additive quantisation: beam-search codes, stored norms, table scores, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors in a block of codes, and queries in a block of queries, at most. A pair of blocks is a task's unit of work. Blocks of codes are large, so that few
#: of them leave a shortlist for each query, blocks of queries so that codes are sent few times; while blocks are fewer than the tasks that run at once, queries are dealt
#: out further, LEAST to a block at least. A task scores SCORED codes against ASKED queries at once.
CODES, QUERIES, LEAST = 262_144, 8_192, 1_024
SCORED, ASKED = 16_384, 64
#: Components of all queries up to which these are broadcast for the exact comparison; above, that join shuffles.
BROADCAST_COMPONENTS = 8_000_000


@dataclass(frozen=True)
class Quantiser:
    """codebooks: (levels, entries, dimension); a vector is about the sum of one entry of each, every entry full-dimensional."""

    codebooks: np.ndarray
    beam: int = 8

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, levels) and the norms of what they stand for. At each level the `beam` best partial sums stay."""
        n, levels = len(x), len(self.codebooks)
        residual, codes, cost = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), dtype=np.uint8), None
        for level in range(levels):
            book = self.codebooks[level].astype(np.float32)
            d = (residual**2).sum(-1)[:, :, None] - 2 * residual @ book.T + (book**2).sum(-1)
            width, entries = d.shape[1], d.shape[2]
            flat = d.reshape(n, width * entries)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            rows, old, new = np.arange(n)[:, None], best // entries, best % entries
            residual = residual[rows, old] - book[new]
            codes = np.concatenate([codes[rows, old], new[:, :, None].astype(np.uint8)], axis=2)
            cost = flat[rows, best]
        first = cost.argmin(axis=1)
        rows = np.arange(n)
        return codes[rows, first], np.linalg.norm(x - residual[rows, first], axis=1).astype(np.float32)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(levels * entries, queries): the inner product of every entry with every query."""
        return self.codebooks.reshape(-1, self.codebooks.shape[-1]).astype(np.float32) @ queries.T.astype(np.float32)


def fit_quantiser(sample: np.ndarray, *, levels: int = 16, entries: int = 256, rounds: int = 8, seed: int = 0, beam: int = 8) -> Quantiser:
    """K-means of the residuals, level by level. Fewer sample vectors than entries make fewer entries."""
    rng = np.random.default_rng(seed)
    residual, books = sample.astype(np.float32).copy(), []
    entries = min(entries, len(sample))
    for _ in range(levels):
        book = residual[rng.choice(len(residual), entries, replace=False)].copy()
        for _ in range(rounds):
            nearest = (-2 * residual @ book.T + (book**2).sum(-1)).argmin(axis=1)
            count = np.bincount(nearest, minlength=entries)
            total = np.zeros_like(book)
            np.add.at(total, nearest, residual)
            book[count > 0] = total[count > 0] / count[count > 0, None]
        book[0] = 0  # a level may add nothing
        nearest = (-2 * residual @ book.T + (book**2).sum(-1)).argmin(axis=1)
        residual = residual - book[nearest]
        books.append(book)
    return Quantiser(np.array(books), beam)


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _unit(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one in single precision, and their lengths. Whatever doubles hold fits, for the greatest component is taken out first."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in values])
    most = np.abs(x).max(axis=1, keepdims=True)
    x = x / most
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / norm).astype(np.float32), np.minimum(norm * (most / 2), np.finfo(np.float64).max / 2)[:, 0] * 2


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, shortlist: int = 256, sample: int = 16_384, seed: int = 0, levels: int = 24, beam: int = 8) -> DataFrame:
    """For each query_id of queries (query_id, vector) the k vec_ids of vectors (vec_id, vector) of the largest inner product, its own left out.

    query_id, rank (from 1), vec_id, score: the inner product of the original vectors in double precision. Ties go to the smaller
    vec_id. Vectors that are null or zero or hold a null or a non-finite component take no part; neither do vectors of
    another length than most, nor null ids. Rows repeated in full count once; an id with several vectors, as query or candidate, is listed once, with its
    best score. Fewer candidates than k are all returned; an empty table gives an empty result. Extra columns are not read.

    The quantiser is fitted on a bounded sample (the `sample` distinct vectors of the smallest hashes, taken to length one) on the driver and sent to
    all; every vector is coded. Equal vectors are coded once: no more than k + 1 of them, the smallest ids, can be among the
    nearest. Each block of queries scores each block of codes from its tables, scaled by the stored norm to that of the vector, keeping a running
    `shortlist` of the best for each query, of which the query's `shortlist` best overall are compared exactly.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    good = good.where(F.size("vector") == lengths["n"]).distinct()
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("q")).where(F.col("query_id").isNotNull() & usable(F.col("q")) & (F.size("q") == lengths["n"]))
    # ids stand for nothing here: vectors and queries are numbered as they are written
    asked = stored(asked.distinct().withColumn("asked", F.monotonically_increasing_id()), "queries")
    hashed = good.withColumn("hash", F.xxhash64("vector"))
    few = hashed.withColumn("nth", F.row_number().over(Window.partitionBy("hash", "vector").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    distinct = stored(few.groupBy("hash", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("number", F.monotonically_increasing_id()), "vectors")
    drawn = [r["vector"] for r in distinct.orderBy(F.xxhash64(F.get("ids", F.lit(0)), F.lit(seed)), "hash").limit(sample).select("vector").collect()]
    fitted = spark.sparkContext.broadcast(fit_quantiser(_unit(pd.Series(drawn))[0], levels=levels, beam=beam, seed=seed))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                x, length = _unit(part["vector"])
                codes, norms = fitted.value.encode(x)
                yield pd.DataFrame({"number": part["number"].to_numpy(), "code": [c.tobytes() for c in codes], "norm": norms, "length": length})

    codes = stored(distinct.select("number", "vector").mapInPandas(encode, "number long, code binary, norm float, length double"), "codes")
    blocks = max(1, -(-codes.count() // CODES))
    n_asked = asked.count()
    groups = max(1, -(-n_asked // QUERIES), min(-(-n_asked // LEAST), -(-2 * spark.sparkContext.defaultParallelism // blocks)))
    # each block of queries meets each block of codes; this is the query set against all rows, in blocks
    met = codes.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    spread = asked.withColumn("group", F.pmod(F.xxhash64("asked"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def score(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"asked": [], "number": [], "about": []})
        code = np.frombuffer(b"".join(c["code"]), dtype=np.uint8).reshape(len(c), -1)
        scale = c["length"].to_numpy() / np.maximum(c["norm"].to_numpy(np.float64), 1e-12)
        books, entries = fitted.value.codebooks.shape[:2]
        numbers, keep, out = c["number"].to_numpy(), min(shortlist, len(c)), []
        for at in range(0, len(q), ASKED):
            part = q.iloc[at : at + ASKED]
            table = fitted.value.tables(_unit(part["q"])[0])
            best, which = np.zeros((len(part), 0)), np.zeros((len(part), 0), dtype=np.int64)
            for begin in range(0, len(c), SCORED):
                some = code[begin : begin + SCORED].astype(np.int64)
                about = np.zeros((len(some), len(part)), dtype=np.float32)
                for m in range(books):
                    about += table[m * entries + some[:, m]]
                best = np.concatenate([best, (about * scale[begin : begin + SCORED, None]).T], axis=1)
                which = np.concatenate([which, np.broadcast_to(np.arange(begin, begin + len(some)), (len(part), len(some)))], axis=1)
                top = np.argpartition(-best, min(keep, best.shape[1]) - 1, axis=1)[:, :keep]
                best, which = np.take_along_axis(best, top, axis=1), np.take_along_axis(which, top, axis=1)
            out.append(pd.DataFrame({"asked": np.repeat(part["asked"].to_numpy(), keep), "number": numbers[which].ravel(), "about": best.ravel()}))
        return pd.concat(out)

    scored = spread.groupBy("group", "block").cogroup(met.groupBy("group", "block")).applyInPandas(score, "asked long, number long, about double")
    best = Window.partitionBy("asked").orderBy(F.desc("about"), "number")
    short = scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= shortlist).select("asked", "number")
    few_asked = n_asked * lengths["n"] <= BROADCAST_COMPONENTS
    exact = short.join(distinct.select("number", "vector", "ids"), "number").join(F.broadcast(asked) if few_asked else asked, "asked").withColumn("score", inner_product(F.col("q"), F.col("vector")))
    ids = exact.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").repartition("query_id")
    once = ids.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
