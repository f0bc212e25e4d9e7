"""Codes of vectors by product quantisation, its codebooks from Lloyd's rounds that filter a kd-tree's entries in whole integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .topk import whole_components

#: Vectors of a partition under one set of trees, and parts in a leaf at most.
CHUNK, LEAF = 16_384, 32


@dataclass(frozen=True)
class Tree:
    """A kd-tree over the rows of points (n, width), which are in the order of its leaves. A node is a range of them, with its box, sum and, by its range, count.

    Children come after their node; a leaf has none (0).
    """

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        """Nodes are halved at the median of their widest side; equal points stay one leaf."""
        order, nodes, child, at = np.arange(len(points)), [(0, len(points))], [], 0
        low, high = [], []
        while at < len(nodes):
            a, b = nodes[at]
            own = points[order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            side = int((high[-1] - low[-1]).argmax())
            if b - a > leaf and high[-1][side] > low[-1][side]:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, side], half)]
                child.append(len(nodes))
                nodes += [(a, a + half), (a + half, b)]
            else:
                child.append(0)
            at += 1
        start, end = np.array(nodes).T
        sums = np.concatenate([np.zeros((1, points.shape[1]), dtype=np.int64), points[order].cumsum(axis=0)])
        return cls(points[order], order, start, end, np.array(child), np.array(low), np.array(high), sums[end] - sums[start])

    def nearest(self, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(node, entry of each of its points) for nodes that together hold each point once; equal distances go to the lower entry.

        Of the entries that a node still has, the one nearest to its box's middle is held against the others: where the corner of the box
        that is best for another one is nearer to the first, or as near while the first is the lower, no point of the box can be the other's. One entry left takes the
        whole node; a leaf compares its points with what is left.
        """
        square = (entries * entries).sum(axis=1)
        todo = [(0, np.arange(len(entries)))]
        while todo:
            node, left = todo.pop()
            low, high = self.low[node], self.high[node]
            own = entries[left]
            if len(left) > 1:
                first = int((2 * square[left] - 2 * (own @ (low + high))).argmin())  # twice the distance to the middle, less what all have
                step = own - own[first]
                corner = np.where(step > 0, high, low)
                # |x - other|^2 - |x - first|^2 at that corner x
                more = square[left] - square[left[first]] - 2 * (step * corner).sum(axis=1)
                left = left[(more < 0) | ((more == 0) & (left <= left[first]))]
            if len(left) == 1:
                yield node, left
            elif self.child[node]:
                todo += [(self.child[node], left), (self.child[node] + 1, left)]
            else:
                own = self.points[self.start[node] : self.end[node]]
                yield node, left[(square[left] - 2 * (own @ entries[left].T)).argmin(axis=1)]

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each entry's points add up to, and how many they are. A node that one entry takes adds its cached sum."""
        total, count = np.zeros_like(entries), np.zeros(len(entries), dtype=np.int64)
        for node, entry in self.nearest(entries):
            a, b = self.start[node], self.end[node]
            if len(entry) == 1:
                total[entry[0]] += self.total[node]
                count[entry[0]] += b - a
            else:
                np.add.at(total, entry, self.points[a:b])
                np.add.at(count, entry, 1)
        return total, count

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each point and its squared distance, in the order in which the points came."""
        code, far = np.zeros(len(self.points), dtype=np.int64), np.zeros(len(self.points), dtype=np.int64)
        for node, entry in self.nearest(entries):
            at = slice(self.start[node], self.end[node])
            code[self.order[at]] = entry
            far[self.order[at]] = ((self.points[at] - entries[entry]) ** 2).sum(axis=1)
        return code, far

    def packed(self) -> dict[str, bytes]:
        return {k: v.astype(np.int64).tobytes() for k, v in self.__dict__.items()}

    @classmethod
    def unpacked(cls, row: dict[str, bytes], width: int) -> Tree:
        flat = {k: np.frombuffer(row[k], dtype=np.int64) for k in cls.__dataclass_fields__}
        return cls(**{k: v.reshape(-1, width) if k in ("points", "low", "high", "total") else v for k, v in flat.items()})


def floor_mean(total: np.ndarray, count: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Componentwise floor(total / count); entries that nothing belongs to stay."""
    return np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], before)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of so many rows (fewer at the end) from batches of any size."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= rows:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, rows)
            held, n = whole.slice(rows).to_batches(), n - rows
    if n:
        yield pa.Table.from_batches(held)


def compressed(vectors: DataFrame, *, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """Each kept row of vectors (vec_id, vector, label) as codes: vec_id, code (hex digits of its entries, in part order), error (squared distances, summed), label_error
    (error summed over equal labels, nulls together), codebooks_sha256 (of all final entries' components).

    Components are floor(scale * x). Rows whose vector is null or empty or holds a null or non-finite component are dropped, as are those of another length than most
    (the shorter of lengths as frequent); that length must be a multiple of `parts`, else ValueError. Repeated rows are coded each. Codebooks start as the parts of the `entries`
    smallest vec_ids (null ids last; rows of one id in the order of their components), fewer rows make fewer entries. Components whose squared distances could
    pass a long raise ValueError. An empty table gives an empty result. Extra columns are not read.

    Each partition is cut into chunks of CHUNK rows, whose trees are built once, by part, and written to the shared folder; each round reads them
    and adds up sums and counts by entry in each task, then over the tasks. Only codebooks, of a fixed size, are on the driver and sent to tasks.
    """
    spark = vectors.sparkSession
    whole = vectors.select("vec_id", whole_components(F.col("vector"), scale).alias("whole"), "label").where("whole is not null")
    found = whole.groupBy(F.size("whole").alias("length")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("whole", F.abs))).alias("most")).orderBy(F.desc("n"), "length").first()
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    if found is None:
        return spark.createDataFrame([], schema)
    length, width = found["length"], found["length"] // parts
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    if 16 * length * max(found["most"], 1) ** 2 >= 2**62:
        raise ValueError("the components are too large for whole distances")
    whole = whole.where(F.size("whole") == length)
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    books = np.array([r["whole"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()

    names = [*Tree.__dataclass_fields__]
    tree = f"struct<{', '.join(f'{n}: binary' for n in names)}>"
    own = whole.withColumn("row", F.struct("vec_id", "label")).select("row", "whole")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, CHUNK):
            chunk = chunk.combine_chunks()
            values = chunk["whole"].combine_chunks()
            values = (values.chunk(0) if isinstance(values, pa.ChunkedArray) else values).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, width)
            rows = chunk["row"].combine_chunks()
            rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
            trees = [Tree.of(values[:, p]).packed() for p in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.array([trees], pa.list_(pa.struct([(n, pa.binary()) for n in names])))], ["rows", "trees"])

    forest = stored(own.mapInArrow(build, f"rows array<{own.schema['row'].dataType.simpleString()}>, trees array<{tree}>"), "trees")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
        return ((batch, i) for batch in batches for i in range(batch.num_rows))

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def added(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(sent.value), np.zeros(sent.value.shape[:2], dtype=np.int64)
            for batch, i in each(batches):
                for p, packed in enumerate(batch.column("trees")[i].as_py()):
                    sums, n = Tree.unpacked(packed, width).sums(sent.value[p])
                    total[p] += sums
                    count[p] += n
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": count[p, e], "sums": pa.array(list(total[p, e]), pa.list_(pa.int64()))})

        sums = forest.select("trees").mapInArrow(added, "part int, entry int, n long, sums array<long>")
        met = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")).collect()  # parts * entries rows at most
        total, count = np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64)
        for r in met:
            total[r["part"], r["entry"]], count[r["part"], r["entry"]] = r["sums"], r["n"]
        books = np.stack([floor_mean(total[p], count[p], books[p]) for p in range(parts)])

    sent = spark.sparkContext.broadcast(books)
    digits = len(f"{max(entries - 1, 1):x}")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in each(batches):
            rows = batch.column("rows")[i].values
            found = [Tree.unpacked(packed, width).codes(sent.value[p]) for p, packed in enumerate(batch.column("trees")[i].as_py())]
            texts = ["".join(f"{c:0{digits}x}" for c in row) for row in np.stack([c for c, _ in found], axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([rows.field("vec_id"), rows.field("label"), pa.array(texts), pa.array(sum(far for _, far in found))], ["vec_id", "label", "code", "error"])

    kinds = own.schema["row"].dataType
    codes = stored(forest.mapInArrow(coded, f"vec_id {kinds['vec_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, code string, error long"), "codes")
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
