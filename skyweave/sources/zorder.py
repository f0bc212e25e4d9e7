"""A cube in Z order: what lies close on the grid lies close in the files, so that a chip reads few row groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Coordinates from -HALF to HALF - 1 have keys.
HALF = 1 << 30
#: Shifts and masks that put a zero between any two bits of a number of 32.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def key(y: Column, x: Column) -> Column:
    """The bits of y and x in turn, y's first, as one long; a place beyond HALF fails the query when it runs."""

    def spread(c: Column) -> Column:
        v = F.when(c.between(-HALF, HALF - 1), c.cast("long") + HALF).when(c.isNotNull(), F.raise_error(F.lit("a place lies beyond the keys' range")).cast("long"))
        for by, mask in SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(y), 1).bitwiseOR(spread(x))


def ranges(box: tuple[int, int, int, int], most: int = 32) -> list[tuple[int, int]]:
    """Ranges of keys, `most` at most, that together hold every place of a box (y0, y1, x0, x1, ends included), and little else.

    Squares that lie across the box's edge are quartered, the largest first, while the number of ranges allows; neighbouring ranges become one.
    """
    y0, y1, x0, x1 = (v + HALF for v in box)
    if y0 > y1 or x0 > x1:
        return []
    side = 1 << 31
    todo, done = [(side, 0, 0, 0)], []  # side, first key, y, x
    while todo:
        todo.sort()
        size, first, y, x = todo.pop()
        inside = y0 <= y and y + size - 1 <= y1 and x0 <= x and x + size - 1 <= x1
        if inside or size == 1 or len(todo) + len(done) + 4 > 4 * most:
            done.append((first, first + size * size - 1))
            continue
        half = size // 2
        for k, (dy, dx) in enumerate(((0, 0), (0, half), (half, 0), (half, half))):
            if y + dy <= y1 and y + dy + half > y0 and x + dx <= x1 and x + dx + half > x0:
                todo.append((half, first + k * half * half, y + dy, x + dx))
    out: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    while len(out) > most:  # close the smallest gap
        k = min(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
        out[k - 1 : k + 1] = [(out[k - 1][0], out[k][1])]
    return out


def write(cells: DataFrame, path: str, *, files: int, within: Sequence[str] = (), block_bytes: int = 16 << 20) -> None:
    """cells (y, x, ...) with their key z, dealt by ranges of z to `files` files and sorted in each, by `within` where z is the same (a place's bands and days).

    block_bytes: size of a row group before compression; small ones let a chip skip more, large ones are read faster.
    """
    keyed = cells.withColumn("z", key(F.col("y"), F.col("x")))
    keyed.repartitionByRange(files, "z", *within).sortWithinPartitions("z", *within).write.option("parquet.block.size", block_bytes).parquet(path)


def read_box(spark: SparkSession, path: str, box: tuple[int, int, int, int], most: int = 32) -> DataFrame:
    """The cells of a box. Ranges of z and of both coordinates reach the scan, which skips the row groups whose statistics lie outside."""
    z = F.lit(False)
    for a, b in ranges(box, most):
        z = z | F.col("z").between(a, b)
    return spark.read.parquet(path).where(z & F.col("y").between(*box[:2]) & F.col("x").between(*box[2:])).drop("z")
