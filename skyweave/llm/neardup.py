"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification, classes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, small_batches, stored, whole_row

#: BANDS bands of ROWS hashes: two texts of similarity 0.8 share none in 1 of 20,000 cases.
BANDS, ROWS = 25, 5
HASHES = 128
#: Hashes compared before the posterior is looked at again.
STEP = 16
#: The greatest chance at one look to drop a pair of just the threshold, whatever the posterior says.
LOSS = 1e-7
#: Texts in a block of a bucket of candidates, and shingles in a block of a group that is verified.
BUCKET, BLOCK = 256, 10_000
#: Texts of a block that are compared at once with as many of another.
SIDE = 1024
#: So many blocks are made before they grow, up to GROWN times; then there are more again.
FEW, GROWN = 32, 80
#: Members of groups (16 bytes each) up to which their table is broadcast; above, the join shuffles.
BROADCAST_ROWS = 1_000_000

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_RANDOM = np.random.default_rng(20240601)
_A = (_RANDOM.integers(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2)) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, HASHES).astype(np.uint32)
_BAND = (_RANDOM.integers(0, 1 << 62, ROWS).astype(np.uint64) * np.uint64(2)) | np.uint64(1)
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _P, dtype=np.uint64)), np.cumprod(np.full(n, _P_INVERSE, dtype=np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts one after another, and how many words each text has."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    gap = _GAP[data]
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    bounds = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], bounds])))
    power, inverse = (x[: len(data)] for x in _powers(1 << max(16, int(len(data)).bit_length())))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
    return _mixed((total[end] - total[start]) * inverse[start]) if len(start) else np.zeros(0, dtype=np.uint64), counts


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of `width` words in a row; a text of fewer words, but one at least, is one shingle."""
    hashes, counts = word_hashes(texts)
    out, at = [], 0
    for n in counts:
        own = hashes[at : at + n]
        at += n
        if not n:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        k = min(width, n)
        s = own[: n - k + 1].copy()
        for j in range(1, k):
            s = s * _P + own[j : n - k + 1 + j]
        out.append(np.unique(_mixed(s + np.uint64(k))))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of x -> a x + b modulo 2**32 over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        best = np.minimum(best, (x[None, at : at + 2048] * _A[:, None] + _B[:, None]).min(axis=1))
    return best


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return _mixed((rows * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For 1, 2, ... HASHES compared values, the least number of equal ones at which the pair is not dropped.

    The similarity is uniform beforehand. A byte of a hash of each value is kept, so different values agree once in 256; the posterior that the
    similarity reaches the threshold is taken over a grid.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = np.zeros(HASHES + 1, dtype=np.int64)
    for n in range(1, HASHES + 1):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        posterior = weight[:, s >= threshold].sum(axis=1) / weight.sum(axis=1)
        out[n] = int(np.argmax(posterior >= tolerance))
    return out


def safe_matches(threshold: float, loss: float = LOSS) -> np.ndarray:
    """For 0, 1, ... HASHES compared values, the greatest number that a pair of just the threshold stays below with a chance of at most `loss`."""
    p = threshold + (1 - threshold) / 256
    out = np.zeros(HASHES + 1, dtype=np.int64)
    for n in range(1, HASHES + 1):
        chance = np.cumsum([math.comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(n + 1)])
        out[n] = int(np.searchsorted(chance, loss, side="right"))
    return out


def sampled_bytes(signature: np.ndarray) -> np.ndarray:
    """A byte of a hash of each whole minimum: the minima of a large set are all small, so their own top bytes would agree between any two."""
    return (_mixed(signature.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), set_hash (16 bytes, equal for equal shingle sets, null where a text has no word), n, keys, bytes (of the signature)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 1):
                sets = shingle_sets(part.column(1).to_pylist())
                signed = [minhash(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    part.column(2),
                    pa.array([set_hash(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([None if x is None else band_keys(x) for x in signed], pa.list_(pa.int64())),
                    pa.array([None if x is None else sampled_bytes(x).tobytes() for x in signed], pa.binary()),
                ], ["doc_id", "text_key", "set_hash", "n", "keys", "bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(make, "doc_id long, text_key long, set_hash binary, n int, keys array<long>, bytes binary")


def set_hash(shingles: np.ndarray) -> bytes | None:
    return hashlib.md5(shingles.tobytes()).digest() if len(shingles) else None


def _blocks(n: Column, each: int) -> Column:
    """Into how many blocks n units are dealt. All pairs of blocks are compared, so a row travels to as many tasks as there are blocks:
    FEW at most until blocks are GROWN times `each`."""
    return F.greatest(F.least(F.ceil(n / each), F.lit(FEW)), F.ceil(n / (each * GROWN)), F.lit(1)).cast("int")


def _survivors(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of y the posterior drops at no look when they are compared with x (rows, or one for all), STEP values at a time."""
    alive, matches = np.arange(len(y)), np.zeros(len(y), dtype=np.int64)
    for at in range(0, HASHES, STEP):
        mine = x[at : at + STEP] if x.ndim == 1 else x[alive, at : at + STEP]
        matches = matches + (mine == y[alive, at : at + STEP]).sum(axis=1)
        on = matches >= least[at + STEP]
        alive, matches = alive[on], matches[on]
        if not len(alive):
            break
    return alive


def _joined(run: np.ndarray, bytes_: np.ndarray, least: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows that join what surviving pairs connect, in each run (numbered in `run`, in order).

    Each row is compared with the first of its run at once. Rows that survive hang together and need no look at each other; every
    other row is compared with all of the run that it is not connected to yet. So no surviving pair is left unconnected, and a run of copies takes one look a row.
    """
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    sizes = np.diff(np.append(starts, len(run)))
    lead = np.repeat(starts, sizes)
    others = np.flatnonzero(lead != np.arange(len(run)))
    kept = others[_survivors(bytes_[lead[others]], bytes_[others], least)]
    out = list(zip(lead[kept].tolist(), kept.tolist()))
    lonely = np.ones(len(run), dtype=bool)
    lonely[kept] = lonely[starts] = False
    left = np.add.reduceat(lonely, starts) if len(starts) else sizes
    for k in np.flatnonzero((left > 0) & (sizes > 2)):
        rows = np.arange(starts[k] + 1, starts[k] + sizes[k])
        part = np.where(lonely[rows], rows, starts[k])  # names of connected parts
        open_ = np.ones(len(rows), dtype=bool)
        for at in np.flatnonzero(lonely[rows]):
            open_[at] = False  # from here on compared with all of the run
            rest = np.flatnonzero((part != part[at]) & (open_ | ~lonely[rows]))
            found = rest[_survivors(bytes_[rows[at]], bytes_[rows[rest]], least)]
            for other in found[np.unique(part[found], return_index=True)[1]]:
                out.append((int(rows[at]), int(rows[other])))
                part[part == part[other]] = part[at]
    return out


def _pruned(met: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """From (key, i, j, id, bytes): edges (a, b) that join what candidate pairs connect, of those with one key, i and j that the posterior drops at no look, or that LOSS keeps."""
    least = np.minimum(least_matches(threshold, tolerance), safe_matches(threshold))

    def edges(part: pa.Table) -> pa.RecordBatch:
        names = [part.column(k).to_numpy() for k in range(3)]
        run = np.cumsum(np.append(False, np.any([x[1:] != x[:-1] for x in names], axis=0)))
        pairs = np.array(_joined(run, np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=np.uint8).reshape(-1, HASHES), least), dtype=np.int64).reshape(-1, 2)
        ids = part.column(3).to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], ["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_tables([*([held] if held else []), pa.Table.from_batches([batch])])
            names = [held.column(k).to_numpy() for k in range(3)]
            last = int(np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in names], axis=0)))[-1])  # the last run may go on in the next batch
            if last:
                yield edges(held.slice(0, last))
                held = held.slice(last)
        if held:
            yield edges(held)

    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInArrow(walk, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), for the nodes of edges (a, b), two different nodes each.

    Every node hooks to the neighbour of the smallest hash if that is smaller than its own; edges are drawn anew between what their ends
    hooked to, until none is left. The order of hashes is random, so that a long chain too loses a share of its nodes in each
    round. Each round is written to the shared folder. Nothing is collected.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("node"))
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(order("b")).alias("best"))
        hooks = stored(best.select(F.col("a").alias("node"), F.least("best", order("a"))["node"].alias("to")), "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("root"))
        else:
            labels = labels.join(hooks.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        moved = edges.join(hooks.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a").join(hooks.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
        edges = stored(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = stored(labels, "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets. Only elements of two sets or more can count."""
    sizes = [len(s) for s in (*left, *right)]
    element, place, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = count >= 2
    column = (np.cumsum(shared) - 1)[place]
    row = np.repeat(np.arange(len(sizes)), sizes)
    on = shared[place]
    row, column = row[on], column[on]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    width = max(256, (1 << 22) // len(sizes))
    for at in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [at, at + width])
        dense = np.zeros((len(sizes), min(width, int(shared.sum()) - at)), dtype=np.float32)
        dense[row[i:j], column[i:j] - at] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def _joining(linked: np.ndarray, part: np.ndarray, at: int, to: int) -> list[tuple[int, int]]:
    """Of the links (row at + r, column to + c) those that first join two parts, named in `part`, which takes them in."""
    out = []
    for r in np.flatnonzero(linked.any(axis=1)):
        columns = np.flatnonzero(linked[r]) + to
        names, first = np.unique(part[columns], return_index=True)
        other = names != part[at + r]
        if other.any():
            out += [(at + int(r), int(c)) for c in columns[first[other]]]
            part[np.isin(part, names[other])] = part[at + r]
    return out


def _compared(left: list[np.ndarray], right: list[np.ndarray] | None, copies: tuple[np.ndarray, np.ndarray], threshold: float, side: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each set of left and of right (None: left with itself), those to copies counted each, and edges between them, right's numbered after left's.

    `side` times `side` pairs are held at once, so short texts, of which a block has many, take no more memory than long ones.
    """
    same = right is None
    right = left if same else right
    after = 0 if same else len(left)
    sizes = [np.array([len(x) for x in s]) for s in (left, right)]
    links = [np.zeros(len(left), dtype=np.int64), np.zeros(len(right), dtype=np.int64)]
    if same:
        links[1] = links[0]
    part, edges = np.arange(after + len(right)), []
    for i in range(0, len(left), side):
        for j in range(i if same else 0, len(right), side):
            rows, columns = slice(i, i + side), slice(j, j + side)
            inter = _intersections(left[rows], right[columns])
            union = sizes[0][rows, None] + sizes[1][None, columns] - inter
            # in whole numbers of shingles, so that a similarity of just the threshold counts
            linked = inter >= np.ceil(threshold * union - 1e-6)
            diagonal = same and i == j
            if diagonal:
                np.fill_diagonal(linked, False)
            links[0][rows] += linked @ copies[1][columns]
            if not diagonal:
                links[1][columns] += linked.T @ copies[0][rows]
            edges += _joining(linked, part, i, after + j)
    return *links, edges


def _verified(groups: DataFrame, threshold: float) -> DataFrame:
    """From (group, i, j, block, id, copies, shingles): a row for each id with its links in these blocks, and edges that join what is linked."""

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        left = frame[frame["block"] == i]
        right = left if i == j else frame[frame["block"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "to": [], "links": []}, dtype="int64")
        a, b = ([np.frombuffer(x, dtype=np.uint64) for x in side["shingles"]] for side in (left, right))
        ids, other = left["id"].to_numpy(), right["id"].to_numpy()
        mine, theirs, edges = _compared(a, None if i == j else b, (left["copies"].to_numpy(), right["copies"].to_numpy()), threshold, SIDE)
        rows = [(ids, mine)] if i == j else [(ids, mine), (other, theirs)]
        names = ids if i == j else np.concatenate([ids, other])
        return pd.concat([pd.DataFrame({"id": x, "to": x, "links": n}) for x, n in rows] + [pd.DataFrame({"id": names[[e[0] for e in edges]], "to": names[[e[1] for e in edges]], "links": 0})] * bool(edges))

    return groups.groupBy("group", "i", "j").applyInPandas(verify, "id long, to long, links long")


def _candidates(reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (a, b) that connect the texts of each bucket as far as pruning leaves pairs. A bucket is compared in blocks, each pair of them a task's unit of work."""
    banded = reps.select("id", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.bit_xor(F.xxhash64("id")).alias("print")).where("size > 1")
    # buckets of other bands that hold the same texts add nothing
    buckets = buckets.groupBy("size", "first", "print").agg(F.min("key").alias("key"))
    held = banded.join(buckets, "key").select("key", "id", _blocks(F.col("size"), BUCKET).alias("blocks")).join(reps.select("id", "bytes"), "id")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # where there are more blocks than one, those of two blocks are compared all with all
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block")))
    met = held.withColumn("block", block).withColumn("other", F.explode(others)).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "bytes")
    return _pruned(met, threshold, tolerance)


def _fetched(docs: DataFrame, members: DataFrame, repeated: bool) -> DataFrame:
    """members (id, doc, set_hash and others) with the shingles of the text of `doc` that has this set. repeated: rows of docs may repeat."""
    rest = [c for c in members.columns if c not in ("doc", "set_hash")]
    schema = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in rest) + ", shingles binary"
    few = members.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null").join(F.broadcast(members) if few else members, "doc").select(*rest, "set_hash", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(rest)
        for batch in batches:
            for part in by_size(batch, n + 1):
                made, wanted = shingle_sets(part.column(n + 1).to_pylist()), part.column(n).to_pylist()
                on = [k for k, s in enumerate(made) if set_hash(s) == wanted[k]]  # another text may bear the same doc_id
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(on, pa.int64())) for k in range(n)), pa.array([made[k].tobytes() for k in on], pa.binary())], [*rest, "shingles"])

    out = texts.mapInArrow(sets, schema)
    return out.dropDuplicates(["id"]) if repeated else out


def _classified(docs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """A row for every row of docs: doc_id, text_key, class (a number, null for a text alone), class_id, links."""
    with small_batches(docs.sparkSession):
        signed = stored(signatures(docs), "signatures")
    own = signed.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_hash").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bytes").alias("bytes"))
    # ids are those of sets, not of documents: they are numbered as they are written
    by_set = stored(own.withColumn("id", F.monotonically_increasing_id()), "sets")
    repeated = not signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    grouped = components(_candidates(by_set.select("id", "keys", "bytes"), threshold, tolerance))
    members = by_set.select("id", "doc", "set_hash", "copies", "n").join(grouped.select(F.col("node").alias("id"), F.col("root").alias("group")), "id")
    blocks = members.groupBy("group").agg(_blocks(F.sum("n"), BLOCK).alias("blocks"))
    members = stored(members.join(blocks, "group").select("id", "group", "copies", "blocks", "doc", "set_hash"), "members")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = _fetched(docs, members, repeated).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "copies", "shingles")
    with small_batches(docs.sparkSession):
        found = stored(_verified(dealt, threshold), "links")
    classes = stored(components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))).join(by_set.select(F.col("id").alias("node"), "doc"), "node"), "classes")
    least = classes.groupBy("root").agg(F.min("doc").alias("class_id"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_set = by_set.select("set_hash", "id", "copies", "doc").join(links, "id", "left").join(classes.join(least, "root").select(F.col("node").alias("id"), "root", "class_id"), "id", "left")
    of_set = of_set.select("set_hash", F.coalesce("root", "id").alias("class"), F.coalesce("class_id", "doc").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("links"))
    out = signed.where("doc_id is not null").select("doc_id", "text_key", "set_hash").join(of_set, "set_hash", "left")
    nameless = signed.where("doc_id is null").select("doc_id", "text_key", F.lit(None).cast("long").alias("class"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return out.select("doc_id", "text_key", "class", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links")).union(nameless)


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, tolerance: float = 1e-5) -> DataFrame:
    """A row for every row of docs: doc_id, class_id (the smallest doc_id of its class), links.

    Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of threshold or more; words are runs of
    anything but ASCII white space, in their own case. links counts the other documents linked to one, copies each. A class is what links connect.
    A text of one to four words is one shingle. Null texts and those without a word have no links and are a
    class each. Rows that share a doc_id are copies or not by their texts alone; rows of null doc_id have no class and no links. Extra columns are not read; an empty table gives an empty result.

    Texts of equal sets are one to all steps after the first, so copies cost nothing. Those that share a bucket of a band are pruned by the
    posterior; what this leaves makes groups, whose shingle sets are fetched once and compared exactly, all with all. Large buckets and groups are both compared in blocks.
    """
    return _classified(docs, threshold, tolerance).select("doc_id", "class_id", "links")


def one_of_each(docs: DataFrame, *, threshold: float = 0.8, tolerance: float = 1e-5) -> DataFrame:
    """docs, whatever its other columns, with one row of each class: of the smallest doc_id, and where rows share that, of the smallest hash of the text. Rows of null doc_id and texts without a word stay."""
    rows = ["class", "doc_id", "text_key"]
    several = stored(_classified(docs, threshold, tolerance).where("links > 0").groupBy(*rows).agg(F.count("*").alias("rows")), "several")
    first = several.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("class", "first.doc_id", "first.text_key")
    gone = stored(several.join(first, rows, "left_anti").select("doc_id", "text_key"), "gone")
    repeated = several.where("rows > 1").join(first, rows, "left_semi").select("doc_id", "text_key")
    sent = F.broadcast if several.count() <= BROADCAST_ROWS else lambda df: df
    keyed = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    kept = keyed.join(sent(gone), ["doc_id", "text_key"], "left_anti")
    if repeated.isEmpty():
        return kept.select("row.*")
    once = kept.join(sent(repeated), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return kept.join(sent(repeated), ["doc_id", "text_key"], "left_anti").union(once).select("row.*")
