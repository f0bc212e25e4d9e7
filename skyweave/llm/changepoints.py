"""Penalised change points: optimal partitioning of each key's daily series by dynamic programming."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs of start and end pairs that are held at once: a series of many years is cut into groups of end days.
CELLS = 1 << 18
LIMIT = 1 << 62


def spreads(sums: np.ndarray, squares: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """V = 1 + floor((n Q - S S) / (n n)) of the days between starts and ends, exact: prefix sums beyond 62 bits are Python integers."""
    n = ends[:, None] - starts[None, :]
    s = sums[ends][:, None] - sums[starts][None, :]
    q = squares[ends][:, None] - squares[starts][None, :]
    return 1 + (n * q - s * s) // np.maximum(n * n, 1)


def costs(n: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """n * floor(1000 ln V), the logarithm in double precision."""
    return n * np.floor(1000 * np.log(spread.astype(np.float64))).astype(np.int64)


def segmented(values: list[int], least: int, penalty: int) -> tuple[int, list[int]]:
    """The least sum of costs with `penalty` for each cut, and where segments of `least` days or more start.

    Ends are taken in order; each one's best start is the earliest of those of the smallest (cost, segments), looked for among all starts at once.
    Following the starts back from the last day gives the earliest starts, compared from the last segment backwards.
    """
    n = len(values)
    total, squares = [0], [0]
    for v in values:
        total.append(total[-1] + v)
        squares.append(squares[-1] + v * v)
    wide = n * squares[-1] + max(abs(min(total)), max(total)) ** 2 * 4 >= LIMIT
    kind = object if wide else np.int64
    sums, squares = np.array(total, dtype=kind), np.array(squares, dtype=kind)
    scale = n + 1  # (cost, segments) as one number
    best, back = np.full(n + 1, LIMIT, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    best[0] = -(penalty * scale)  # the first segment pays for no cut
    least = min(least, n)
    step = max(1, CELLS // (n + 1))
    for first in range(least, n + 1, step):
        ends = np.arange(first, min(first + step, n + 1))
        starts = np.arange(0, ends[-1] - least + 1)
        length = np.maximum(ends[:, None] - starts[None, :], 1)
        price = costs(length, spreads(sums, squares, ends, starts)) * scale + (penalty * scale + 1)
        for row, end in zip(price, ends):
            reach = best[: end - least + 1] + row[: end - least + 1]
            back[end] = at = int(reach.argmin())
            best[end] = reach[at]
    found, at = [], n
    while at > 0:
        at = int(back[at])
        found.append(at)
    return int(best[n]) // scale, found[::-1]


def change_points(rows: DataFrame, key: str, day: str, value: str, *, least: int = 7, penalty: int = 20_000) -> DataFrame:
    """Segments of each key's series of daily sums, from its first to its last day, days between without any row 0.

    rows: a key, a day (date) and a whole number; rows that have no day or no value take no part, repeated ones count each time, a null key is a
    key like any other, other columns are not read. A series of fewer than 2 * least days is one segment. key, segment_no (from 1), first_day (days since
    1970), n_days, total, spread (V), cost, n_segments, best_cost (of the whole series, penalties included). An empty table gives no segments.
    A spread that no long holds is null; its cost is right all the same.

    Sums by key and day are made before anything meets by key, so a task gets a row for each day of a key, however many rows the key has. A series is
    held by one task: its work grows with the square of its days, its memory with the days.
    """
    taken = rows.where(F.col(day).isNotNull() & F.col(value).isNotNull())
    daily = taken.groupBy(F.col(key).alias("key"), F.unix_date(F.col(day).cast("date")).cast("long").alias("day")).agg(F.sum(F.col(value).cast("long")).alias("total"))

    def cut(name: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        days, totals = frame["day"].to_numpy(), frame["total"].to_numpy()
        first, n = int(days.min()), int(days.max() - days.min()) + 1
        series = np.zeros(n, dtype=np.int64)
        series[days - first] = totals
        values = series.tolist()
        best, starts = segmented(values, least, penalty)
        ends = [*starts[1:], n]
        spread = []
        for a, b in zip(starts, ends):
            part = values[a:b]
            spread.append(1 + ((b - a) * sum(v * v for v in part) - sum(part) ** 2) // (b - a) ** 2)
        length = np.array(ends) - np.array(starts)
        out = {
            "key": pd.Series([None if pd.isna(name[0]) else name[0]] * len(starts), dtype=object), "segment_no": np.arange(1, len(starts) + 1, dtype=np.int32), "first_day": first + np.array(starts), "n_days": length,
            "total": [sum(values[a:b]) for a, b in zip(starts, ends)], "spread": pd.Series([v if v < 1 << 63 else None for v in spread], dtype=object), "cost": costs(length, np.array([float(v) for v in spread])), "n_segments": len(starts), "best_cost": best,
        }
        return pd.DataFrame(out)

    schema = f"key {daily.schema['key'].dataType.simpleString()}, segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"
    return daily.groupBy("key").applyInPandas(cut, schema).withColumnRenamed("key", key)
