"""A grid as tiles: squares of cells as arrays, whose borders are sent to their neighbours once; neighbourhoods are then sums of shifted arrays.

The same statistics as in `focal`, for dense grids: rows are shuffled once, into their tiles; after that only borders move, however many
neighbourhoods an operator looks at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import circle_offsets

#: Cells along a side of a tile.
SIDE = 256
Layers = np.ndarray  # (layers, rows, columns); NaN is missing; the first layer is 1 where the table has a row
Kernel = Callable[[Layers, int], Layers]


def to_tiles(cells: DataFrame, values: Sequence[str] = ("value",), keys: Sequence[str] = ("band",), side: int = SIDE) -> DataFrame:
    """keys, ty, tx and, for side * side cells at most, where they lie in the tile (at) and their values (v0, v1, ...; NaN where missing). A cell must have one row at most.

    One shuffle, to tiles of a bounded size. Missing values and missing rows are told apart.
    """
    place = (F.pmod(F.col("y"), F.lit(side)) * side + F.pmod(F.col("x"), F.lit(side))).cast("int")
    lists = {"at": place} | {f"v{i}": F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))) for i, v in enumerate(values)}
    own = cells.select(*keys, F.floor(F.col("y") / side).cast("int").alias("ty"), F.floor(F.col("x") / side).cast("int").alias("tx"), *[c.alias(f"_{n}") for n, c in lists.items()])
    return own.groupBy(*keys, "ty", "tx").agg(*[F.collect_list(f"_{n}").alias(n) for n in lists])  # filled row by row, none of them null, so that they stay in step


def _lists(layers: int) -> list[str]:
    return ["at", *[f"v{i}" for i in range(layers)]]


def _filled(place: np.ndarray | None, values: Sequence[np.ndarray], side: int) -> Layers:
    """Presence and values of a tile as layers; nothing where the tile has no row."""
    tile = np.full((1 + len(values), side * side), np.nan)
    if place is not None:
        tile[0, place] = 1
        for layer, own in zip(tile[1:], values):
            layer[place] = own
    return tile.reshape(-1, side, side)


def _array(packed: bytes, layers: int, *shape: int) -> Layers:
    return np.frombuffer(packed, dtype=np.float64).reshape(layers, *shape)


def _strip(d: int, n: int, radius: int) -> slice:
    """What a tile sends to the neighbour on side d: its last, first or all rows."""
    return slice(n - radius, n) if d > 0 else slice(0, radius) if d < 0 else slice(0, n)


def _seat(d: int, n: int, radius: int) -> slice:
    """Where that lies in the neighbour's padded array."""
    return slice(0, radius) if d > 0 else slice(radius + n, 2 * radius + n) if d < 0 else slice(radius, radius + n)


def on_tiles(tiles: DataFrame, layers: int, reach: int, kernel: Kernel, *, keys: Sequence[str] = ("band",), side: int = SIDE, beyond: bool = False) -> DataFrame:
    """keys, ty, tx and tile (binary): kernel(padded, reach) of each tile of to_tiles() with `reach` cells of its neighbours around it, one exchange of borders.

    layers: of values, besides the first of presence. kernel returns layers of side * side cells. beyond: tiles that have no row themselves but borders of neighbours count too.
    """
    if not 0 < reach <= side:
        raise ValueError(f"a neighbourhood must reach 1 to {side} cells: {reach}")
    n, lists = layers + 1, _lists(layers)

    def sent(at: pd.Series, *values: pd.Series) -> pd.Series:
        out = []
        for place, *own in zip(at, *values):
            tile = _filled(place, own, side)
            parts = [(dy, dx, np.ascontiguousarray(tile[:, _strip(dy, side, reach), _strip(dx, side, reach)])) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
            out.append([{"dy": dy, "dx": dx, "part": part.tobytes()} for dy, dx, part in parts if not np.isnan(part[0]).all()])
        return pd.Series(out)

    def worked(borders: pd.Series, at: pd.Series, *values: pd.Series) -> pd.Series:
        out = []
        for parts, place, *own in zip(borders, at, *values):
            padded = np.full((n, side + 2 * reach, side + 2 * reach), np.nan)
            padded[:, reach : reach + side, reach : reach + side] = _filled(place, own, side)
            for b in parts if parts is not None else ():
                rows, columns = side if not b["dy"] else reach, side if not b["dx"] else reach
                padded[:, _seat(b["dy"], side, reach), _seat(b["dx"], side, reach)] = _array(b["part"], n, rows, columns)
            out.append(np.ascontiguousarray(kernel(padded, reach), dtype=np.float64).tobytes())
        return pd.Series(out)

    names = [*keys, "ty", "tx"]
    border = F.pandas_udf(sent, "array<struct<dy:int,dx:int,part:binary>>")
    moved = tiles.select(*names, F.explode(border(*lists)).alias("b")).select(*keys, (F.col("ty") + F.col("b.dy")).alias("ty"), (F.col("tx") + F.col("b.dx")).alias("tx"), "b")
    met = moved.groupBy(*names).agg(F.collect_list("b").alias("borders"))
    # no Python stands between the tiles' aggregate and this join, so it takes them as they are dealt out
    return tiles.join(met, names, "full" if beyond else "left").select(*names, F.pandas_udf(worked, "binary")("borders", *lists).alias("tile"))


def to_cells(tiles: DataFrame, values: Sequence[str], *, keys: Sequence[str] = ("band",), side: int = SIDE) -> DataFrame:
    """keys, y, x and the values of the cells of tiles of on_tiles() whose first layer says that they are there; missing values are null."""
    own = tiles.select(*keys, "ty", "tx", "tile")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tile = _array(batch.column("tile")[i].as_py(), 1 + len(values), side, side)
                y, x = np.nonzero(tile[0] == 1)
                whole = batch.select(list(keys)).slice(i, 1).take(pa.array(np.zeros(len(y), dtype=np.int64)))
                top, left = batch.column("ty")[i].as_py() * side, batch.column("tx")[i].as_py() * side
                columns = [*whole.columns, pa.array((top + y).astype(np.int32)), pa.array((left + x).astype(np.int32)), *(pa.array(v[y, x], from_pandas=True) for v in tile[1:])]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "y", "x", *values])

    return own.mapInArrow(rows, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "y int", "x int", *[f"`{v}` double" for v in values]]))


def _shifted(a: np.ndarray, dy: int, dx: int, reach: int) -> np.ndarray:
    """The part of a padded array that lies (dy, dx) off its inner part."""
    return a[reach + dy : a.shape[0] - reach + dy, reach + dx : a.shape[1] - reach + dx]


def _circle(a: np.ndarray, radius: float, reach: int, add: Callable) -> np.ndarray:
    """What add() makes of all cells of a circle around each inner cell. Along x the reach grows step by step; each row of the circle takes the one of its width."""
    widths: dict[int, list[int]] = {}
    for dy in range(-int(radius), int(radius) + 1):
        widths.setdefault(max(dx for y, dx in circle_offsets(radius) if y == dy), []).append(dy)
    inner = slice(reach, a.shape[1] - reach)
    along, total = a[:, inner].copy(), None
    for w in range(max(widths) + 1):
        if w:
            along = add(add(along, a[:, reach - w : a.shape[1] - reach - w]), a[:, reach + w : a.shape[1] - reach + w])
        for dy in widths.get(w, ()):
            part = along[reach + dy : a.shape[0] - reach + dy]
            total = part.copy() if total is None else add(total, part)
    return total


def circle_mean(values: np.ndarray, radius: float, reach: int) -> np.ndarray:
    """Mean of the valid cells of a circle; NaN where there is none."""
    valid = ~np.isnan(values)
    total, count = _circle(np.where(valid, values, 0.0), radius, reach, np.add), _circle(valid.astype(np.float64), radius, reach, np.add)
    return np.where(count > 0, total / np.maximum(count, 1), np.nan)


def circle_max(values: np.ndarray, radius: float, reach: int) -> np.ndarray:
    return _circle(values, radius, reach, np.fmax)


def _box(a: np.ndarray, radius: int) -> np.ndarray:
    """Sums over squares; the result is smaller by radius on every side."""
    rows = sum(a[:, radius + d : a.shape[1] - radius + d] for d in range(-radius, radius + 1))
    return sum(rows[radius + d : rows.shape[0] - radius + d] for d in range(-radius, radius + 1))


def focal(cells: DataFrame, radius: float, how: str = "avg", side: int = SIDE) -> DataFrame:
    """avg or max over a circle at every place that a valid cell reaches, on the grid or beyond: band, y, x, focal."""
    if how not in ("avg", "max"):
        raise ValueError(f"no such statistic: {how!r}")
    over = circle_mean if how == "avg" else circle_max

    def kernel(padded: Layers, reach: int) -> Layers:
        out = over(padded[1], radius, reach)
        return np.stack([np.where(np.isnan(out), np.nan, 1.0), out])

    return to_cells(on_tiles(to_tiles(cells, side=side), 1, max(1, int(radius)), kernel, side=side, beyond=True), ["focal"], side=side)


def fill_square(cells: DataFrame, radius: int, rounds: int = 2, side: int = SIDE) -> DataFrame:
    """Missing values from the mean of a square, again and again; valid ones stay. One exchange of borders serves all rounds."""

    def kernel(padded: Layers, reach: int) -> Layers:
        there, value = padded[0] == 1, padded[1]
        for _ in range(rounds):
            valid = ~np.isnan(value)
            total, count = _box(np.where(valid, value, 0.0), radius), _box(valid.astype(np.float64), radius)
            inner = (slice(radius, -radius), slice(radius, -radius))
            value, there = value[inner], there[inner]
            value = np.where(there & np.isnan(value) & (count > 0), total / np.maximum(count, 1), value)
        return np.stack([np.where(there, 1.0, np.nan), value])

    return to_cells(on_tiles(to_tiles(cells, side=side), 1, radius * rounds, kernel, side=side), ["value"], side=side)


def moving_fit(pairs: DataFrame, radius: int, side: int = SIDE) -> DataFrame:
    """band, y, x, alpha, beta of fine = alpha * coarse + beta over a square around each cell, from pairs both of which are valid."""

    def kernel(padded: Layers, reach: int) -> Layers:
        there, v, m = padded
        both = ~np.isnan(v) & ~np.isnan(m)
        v, m = np.where(both, v, 0.0), np.where(both, m, 0.0)
        n, sm, sv, smv, smm = (_box(a, radius) for a in (both.astype(np.float64), m, v, m * v, m * m))
        det = n * smm - sm * sm
        fits = (n > 1) & (det > 1e-9 * n * smm)
        alpha = np.where(fits, (n * smv - sm * sv) / np.where(fits, det, 1.0), np.nan)
        return np.stack([_shifted(there, 0, 0, reach), alpha, (sv - alpha * sm) / np.maximum(n, 1)])

    return to_cells(on_tiles(to_tiles(pairs, ["fine", "coarse"], side=side), 2, radius, kernel, side=side), ["alpha", "beta"], side=side)


def edge_blend(stages: DataFrame, radius: float = 1.5, side: int = SIDE) -> DataFrame:
    """band, y, x, blended: the focal mean of the patched image where raw is missing, raw where it is valid."""

    def kernel(padded: Layers, reach: int) -> Layers:
        there, raw, _ = (_shifted(a, 0, 0, reach) for a in padded)
        return np.stack([there, np.where(np.isnan(raw), circle_mean(padded[2], radius, reach), raw)])

    return to_cells(on_tiles(to_tiles(stages, ["raw", "patched"], side=side), 2, max(1, int(radius)), kernel, side=side), ["blended"], side=side)


def feather(stages: DataFrame, radius: float = 5.0, side: int = SIDE) -> DataFrame:
    """band, y, x, feathered: raw * w + patched * (1 - w), w the focal mean of raw's mask, 0 where raw is missing."""

    def kernel(padded: Layers, reach: int) -> Layers:
        there, raw, patched = (_shifted(a, 0, 0, reach) for a in padded)
        mask = np.where(padded[0] == 1, (~np.isnan(padded[1])).astype(np.float64), np.nan)
        w = np.where(np.isnan(raw), 0.0, circle_mean(mask, radius, reach))
        return np.stack([there, np.where(np.isnan(raw), 0.0, raw) * w + patched * (1 - w)])

    return to_cells(on_tiles(to_tiles(stages, ["raw", "patched"], side=side), 2, max(1, int(radius)), kernel, side=side), ["feathered"], side=side)
