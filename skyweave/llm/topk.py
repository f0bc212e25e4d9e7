"""Exact top-k search: histograms of all scores, refined until they show each query's k-th value, then a filter and a tie rule."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows in a block of candidates and in a block of queries at most; a pair of blocks is a task's unit of work. Large blocks keep the copies few.
BLOCK = 131_072
#: Candidates of a block at least, while blocks are fewer than tasks that run at once.
LEAST = 2_048
#: A task scores so many queries against so many candidates at once.
ASKED, SCORED = 64, 16_384
#: Bins of a histogram, as a power of two.
BITS = 10


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as double, null where the vector is null, empty or holds a null or non-finite component."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce((F.size(vector) > 0) & good, F.lit(False)), F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def _matrix(values: pd.Series, kind: type) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(kind)


def nearest_exact(vectors: DataFrame, queries: DataFrame, *, k: int = 5, scale: int = 256) -> DataFrame:
    """For each query_id of queries (query_id, vector) the k vec_ids of vectors (vec_id, vector) of the highest integer inner product, its own left out.

    query_id, rank (from 1), vec_id, score. Components are floor(scale * x); ties go to the smaller vec_id. Vectors that are null or empty or hold a null or
    non-finite component take no part, nor do null ids; a query meets the vectors of its own length. An id stands for one vector: repeated rows
    count once, of several vectors the smallest in the order of their components counts, as query and candidate. Fewer candidates than k are all returned;
    an empty table gives an empty result. Extra columns are not read. Components whose scores could pass 2**62 raise ValueError.

    Every pass scores all candidates against all queries, in pairs of blocks of at most BLOCK rows. A pass counts each query's scores in 2**BITS bins of the
    range in which its k-th value is known to lie; the counts of all blocks, added up, show the bin it lies in, the next pass's range. A block does not send the
    bins below those that hold k of its own scores, for the k-th value of all is not below that of a part. With bins of one value the k-th
    value is known: blocks send what is above it and, of what equals it, the smallest ids that are still wanted. No list is cut off anywhere.
    """
    spark = vectors.sparkSession
    made = lambda df, name: df.select(F.col(name).cast("long").alias(name), whole_components(F.col("vector"), scale).alias("whole")).where(F.col(name).isNotNull() & F.col("whole").isNotNull()).groupBy(name).agg(F.min("whole").alias("whole"))
    norm = F.sqrt(F.aggregate("whole", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    cands, asked = stored(made(vectors, "vec_id"), "candidates"), stored(made(queries, "query_id"), "asked")
    limits = [df.agg(F.count("*").alias("n"), F.max(norm).alias("norm")).first() for df in (cands, asked)]
    if not limits[0]["n"] or not limits[1]["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # the largest score there can be, one more for the roots' rounding
    bound = math.ceil(limits[0]["norm"] * limits[1]["norm"] * (1 + 1e-9)) + 1
    if bound >= 2**62:
        raise ValueError("the components are too large for whole scores")
    kind = np.float64 if bound < 2**52 else np.int64  # products of whole doubles are exact below 2**53

    workers = spark.sparkContext.defaultParallelism
    blocks = max(-(-limits[0]["n"] // BLOCK), min(2 * workers, -(-limits[0]["n"] // LEAST)))
    groups = -(-limits[1]["n"] // BLOCK)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = cands.select("vec_id", F.col("whole").alias("cand"), F.size("whole").alias("length"), part("vec_id", blocks).alias("block"), every(groups).alias("group")).groupBy("group", "block", "length")
    whole = (2 * bound).bit_length()  # a range of 2**whole values, in bins of 2**width
    width = max(0, whole - BITS)
    state = asked.select("query_id", F.lit(-bound).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))

    def spread(state: DataFrame):
        """The queries with the range that their k-th value lies in, a copy for each block."""
        own = asked.join(state, "query_id").select("query_id", "whole", "low", "need", F.size("whole").alias("length"), part("query_id", groups).alias("group"), every(blocks).alias("block"))
        return own.groupBy("group", "block", "length")

    def scores(q: pd.DataFrame, c: pd.DataFrame) -> Iterator[tuple[slice, slice, np.ndarray]]:
        cand, ask = _matrix(c["cand"], kind), _matrix(q["whole"], kind)
        ids, own = c["vec_id"].to_numpy(), q["query_id"].to_numpy()
        for a in range(0, len(q), ASKED):
            for b in range(0, len(c), SCORED):
                s, t = slice(a, min(a + ASKED, len(q))), slice(b, min(b + SCORED, len(c)))
                out = (ask[s] @ cand[t].T).astype(np.int64)
                out[own[s, None] == ids[None, t]] = -(2**62)  # below every range
                yield s, t, out

    def counted(shift: int, bins: int):
        def count(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(c):
                return pd.DataFrame({"query_id": [], "bin": [], "n": []})
            n, low = np.zeros((len(q), bins), dtype=np.int64), q["low"].to_numpy()
            for s, _, score in scores(q, c):
                at = (score - low[s, None]) >> shift
                inside = (at >= 0) & (at < bins)
                row = np.broadcast_to(np.arange(len(at))[:, None] * bins, at.shape)
                n[s] += np.bincount((row + at)[inside], minlength=len(at) * bins).reshape(len(at), bins)
            above = n[:, ::-1].cumsum(axis=1)[:, ::-1] - n  # in higher bins of this block
            row, at = np.nonzero((n > 0) & (above < q["need"].to_numpy()[:, None]))
            return pd.DataFrame({"query_id": q["query_id"].to_numpy()[row], "bin": at, "n": n[row, at]})

        return count

    while True:
        seen = spread(state).cogroup(met).applyInPandas(counted(width, 1 << (whole - width)), "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        above = seen.withColumn("above", F.sum("n").over(down) - F.col("n"))
        found = state.join(above.withColumnRenamed("n", "here"), "query_id", "left").where("bin is null or above < need").groupBy("query_id", "low", "need").agg(F.min_by(F.struct("bin", "above", "here"), "bin").alias("at"))
        # a query with too few candidates gets them all: nothing is below its range
        short = F.col("at").isNull() | (F.col("at.above") + F.col("at.here") < F.col("need"))
        state = stored(found.select("query_id", F.when(short, -bound - 1).otherwise(F.col("low") + F.col("at.bin") * (1 << width)).cast("long").alias("low"), F.when(short, F.col("need")).otherwise(F.col("need") - F.col("at.above")).alias("need")), "range")
        if width == 0:
            break
        whole, width = width, max(0, width - BITS)

    def kept(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        if len(q) and len(c):
            c = c.sort_values("vec_id")
            ids, own, low = c["vec_id"].to_numpy(), q["query_id"].to_numpy(), q["low"].to_numpy()
            left = q["need"].to_numpy().copy()  # of equal scores the smallest ids come first, in one part of the block after another
            for s, t, score in scores(q, c):
                same = score == low[s, None]
                nth = same.cumsum(axis=1)
                row, at = np.nonzero((score > low[s, None]) | (same & (nth <= left[s, None])))
                left[s] -= np.minimum(nth[:, -1], left[s])
                out.append(pd.DataFrame({"query_id": own[s][row], "vec_id": ids[t][at], "score": score[row, at]}))
        return pd.concat(out).astype({"query_id": np.int64, "vec_id": np.int64, "score": np.int64})

    listed = spread(state).cogroup(met).applyInPandas(kept, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
