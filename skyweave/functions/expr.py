"""Column expressions: missing values, quality bits, scaling, indices, stretches, geometry."""

from __future__ import annotations

import datetime
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the fine sensor's scaling.
SCALE, OFFSET = 0.0000275, -0.2


def finite(v: Column) -> Column:
    """NaN and infinities become null, the only missing value."""
    v = v.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def bits_clear(qa: Column, mask: int) -> Column:
    return qa.bitwiseAND(F.lit(mask)) == 0


def strict_clear(qa: Column, radsat: Column) -> Column:
    """Bits 0 to 5 clear, no saturation."""
    return bits_clear(qa, 63) & (radsat == 0)


def cloud_shadow_clear(qa: Column) -> Column:
    return bits_clear(qa, 24)


def extended_clear(qa: Column) -> Column:
    return bits_clear(qa, 30)


def coarse_clear(state: Column, red: Column) -> Column:
    """Cloud state, shadow, cirrus and internal cloud bits clear, and a dark enough raw red."""
    return bits_clear(state, 3) & bits_clear(state, 4) & bits_clear(state, 768) & bits_clear(state, 1024) & (red < 1500)


def reflectance(dn: Column) -> Column:
    return dn * SCALE + OFFSET


def clip(v: Column, low: float | None = 0.0, high: float | None = 1.0) -> Column:
    """Into [low, high]; missing stays missing. A bound of None is none."""
    out = v if high is None else F.least(F.lit(high), v)
    out = out if low is None else F.greatest(F.lit(low), out)
    return F.when(v.isNotNull(), out)


def normalized_difference(a: Column, b: Column, zero: float | None = None) -> Column:
    """(a - b) / (a + b); `zero` where the sum is zero."""
    return F.when(a.isNull() | b.isNull(), None).when(a + b == 0, F.lit(zero).cast("double")).otherwise((a - b) / (a + b))


def guarded_difference(a: Column, b: Column, least: float = 1e-4) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), (a - b) / F.greatest(a + b, F.lit(least)))


def stretch(v: Column, low: float, high: float) -> Column:
    return clip((v - low) / (high - low))


def residual_colour(residual: Column, most: float = 0.15) -> Column:
    """A residual as a shade from 0 to 1: -most is 0, none 0.5, most 1."""
    return stretch(residual, -most, most)


def pass_label(day: Column, prefix: str) -> Column:
    """The name under which a pass is stored: the prefix and the date without its dashes."""
    return F.concat(F.lit(f"{prefix}_"), F.replace(day.cast("string"), F.lit("-"), F.lit("")))


def within_box(x: Column, y: Column, cx: float, cy: float, r: float) -> Column:
    return (F.abs(x - cx) <= r) & (F.abs(y - cy) <= r)


def within_circle(x: Column, y: Column, cx: float, cy: float, r: float) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r


def within_ring(x: Column, y: Column, cx: float, cy: float, r: float, width: float) -> Column:
    return ~within_circle(x, y, cx, cy, r) & within_circle(x, y, cx, cy, r + width)


def checked_date(text: str) -> datetime.date:
    """A canonical YYYY-MM-DD date."""
    if not isinstance(text, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"not a YYYY-MM-DD date: {text!r}")
    return datetime.date.fromisoformat(text)


def day_number(when: int | str) -> int:
    """Days since 1970-01-01 of a canonical date; a number is one already."""
    if isinstance(when, int) and not isinstance(when, bool):
        return when
    return (checked_date(when) - datetime.date(1970, 1, 1)).days


def checked_window(days) -> int:
    if isinstance(days, bool) or not isinstance(days, int) or days < 1:
        raise ValueError(f"a window is a positive whole number of days: {days!r}")
    return days


def circle_offsets(radius: float) -> list[tuple[int, int]]:
    n = math.floor(radius)
    return [(dy, dx) for dy in range(-n, n + 1) for dx in range(-n, n + 1) if dy * dy + dx * dx <= radius * radius]
