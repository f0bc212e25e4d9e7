"""Filling gaps in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import checked_window, day_number

KEYS = ("band", "y", "x")


def _days_twice(first: int, last: int) -> Column:
    """Whether a day occurs twice in a group of days of a range: the days seen are bits of a few longs."""
    parts = range(first, last + 1, 62)
    if len(parts) > 16:
        return F.count("d") > F.count_distinct("d")
    seen = [F.bit_count(F.coalesce(F.bit_or(F.when(F.col("d").between(p, p + 61), F.expr(f"shiftleft(1L, d - ({p}))"))), F.lit(0))) for p in parts]
    return F.count("d") > sum(seen[1:], seen[0])


def brackets(cells: DataFrame, when: int | str, max_distance: int, keys: Sequence[str] = KEYS, days: dict[str, int] | None = None) -> DataFrame:
    """For each key the nearest values before and after day `when`, not further than max_distance (inclusive), that day left out.

    One partial and one final aggregate: the as-of join in both directions at once. days: names of more columns, the values of these days, from the same
    pass. A day that occurs twice in a series fails the query when it runs: days must be mosaicked first.
    """
    t, n, days = day_number(when), checked_window(max_distance), days or {}
    near = F.abs(F.col("d") - t).between(1, n)
    at = lambda test, c: F.when(test, F.col(c))
    before, after = near & (F.col("d") < t), near & (F.col("d") > t)
    first, last = min([t - n, *days.values()]), max([t + n, *days.values()])
    rows = cells.where(F.col("d").between(first, last) & (near | F.col("d").isin(*days.values())) & F.col("value").isNotNull())
    once = F.when(_days_twice(first, last), F.raise_error(F.lit("a day occurs twice in a series"))).otherwise(F.max(at(before, "d")))
    return rows.groupBy(*keys).agg(
        F.max_by(at(before, "value"), at(before, "d")).alias("vb"), once.alias("db"), F.min_by(at(after, "value"), at(after, "d")).alias("va"), F.min(at(after, "d")).alias("da"),
        *[F.max(at(F.col("d") == d, "value")).alias(name) for name, d in days.items()])


def interpolated(vb: Column, va: Column, age_before: Column, age_after: Column) -> Column:
    return vb + (age_before.cast("double") / (age_before + age_after)) * (va - vb)


def _usable(cells: DataFrame, valid: str | None, columns: Sequence[str]) -> DataFrame:
    """cells that a mask lets through, after a look at the columns' names and the mask's type."""
    missing = [c for c in [*columns, *([valid] if valid else [])] if c not in cells.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    if valid and dict(cells.dtypes)[valid] != "boolean":
        raise ValueError(f"{valid} must be boolean")
    return cells.where(valid) if valid else cells


def _estimates(joined: DataFrame, t: int, kept: Sequence[str], allow_one_sided: bool) -> DataFrame:
    both = F.col("db").isNotNull() & F.col("da").isNotNull()
    age_b, age_a = F.lit(t) - F.col("db"), F.col("da") - F.lit(t)
    prediction, status = F.when(both, interpolated(F.col("vb"), F.col("va"), age_b, age_a)), F.when(both, 1)
    if allow_one_sided:
        prediction = prediction.when(F.col("db").isNotNull(), F.col("vb")).when(F.col("da").isNotNull(), F.col("va"))
        status = status.when(F.col("db").isNotNull(), 2).when(F.col("da").isNotNull(), 3)
    out = joined.withColumn("prediction", prediction).withColumn("status", status.otherwise(0))
    return out.select(
        *kept, "prediction", F.coalesce("observed", "prediction").alias("filled"), age_b.cast("double").alias("before_age_days"), age_a.cast("double").alias("after_age_days"),
        (F.col("db").isNotNull().cast("int") + F.col("da").isNotNull().cast("int")).alias("support_count"), "status",
        F.when(F.col("observed").isNotNull(), 1).when(F.col("status") > 0, F.col("status") + 1).otherwise(0).alias("filled_origin"))


def interpolate(cells: DataFrame, target: DataFrame, when: int | str, max_distance: int = 32, *, allow_one_sided: bool = False, keys: Sequence[str] = KEYS, valid: str | None = None) -> DataFrame:
    """Every row of target (keys, observed) with prediction, filled, ages, support_count, status and filled_origin.

    when: a day's number or its date as YYYY-MM-DD. valid: a boolean column of cells; what it does not let through is missing.
    status: 0 unresolved, 1 interpolated, 2 prior, 3 future. filled_origin: 0 none, 1 observed, else status + 1. Ages stay where one side
    alone was found; status is of the prediction, also where the target was observed. Bad arguments raise ValueError; a day that occurs twice in a series fails the query.
    """
    t = day_number(when)
    _usable(target, None, [*keys, "observed"])
    j = target.join(brackets(_usable(cells, valid, [*keys, "d", "value"]), t, max_distance, keys), list(keys), "left")
    return _estimates(j, t, target.columns, allow_one_sided)


def interpolate_on_grid(cells: DataFrame, grid: DataFrame, when: int | str, max_distance: int = 32, *, allow_one_sided: bool = False, keys: Sequence[str] = KEYS, days: dict[str, int] | None = None) -> DataFrame:
    """interpolate() for the cells of a grid, the target day's own values (observed) and those of other `days` taken in the same pass over cells."""
    t, days = day_number(when), days or {}
    j = grid.join(brackets(cells, t, max_distance, keys, {"observed": t, **days}), list(keys), "left")
    return _estimates(j, t, [*grid.columns, "observed", *days], allow_one_sided)


def fill_days(cells: DataFrame, days: dict[str, int], max_distance: int = 32, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys and, for each name, the value of its day: as observed, or else interpolated between the nearest others. One pass over cells serves all days; keys without any value have no row."""
    n = checked_window(max_distance)
    at = lambda test, c: F.when(test, F.col(c))
    own, parts = lambda d: F.col("d") == d, []
    for name, t in days.items():
        before, after = F.col("d").between(t - n, t - 1), F.col("d").between(t + 1, t + n)
        parts += [F.max(at(own(t), "value")).alias(f"_o_{name}"), F.max_by(at(before, "value"), at(before, "d")).alias(f"_vb_{name}"), F.max(at(before, "d")).alias(f"_db_{name}"), F.min_by(at(after, "value"), at(after, "d")).alias(f"_va_{name}"), F.min(at(after, "d")).alias(f"_da_{name}")]
    near = F.greatest(*[F.col("d").between(t - n, t + n) for t in days.values()]) if len(days) > 1 else F.col("d").between(*[t + s * n for t in days.values() for s in (-1, 1)])
    g = cells.where(near & F.col("value").isNotNull()).groupBy(*keys).agg(*parts)
    filled = lambda c, t: F.coalesce(F.col(f"_o_{c}"), interpolated(F.col(f"_vb_{c}"), F.col(f"_va_{c}"), t - F.col(f"_db_{c}"), F.col(f"_da_{c}") - t))
    return g.select(*keys, *[filled(name, t).alias(name) for name, t in days.items()])


def check_unique_days(cells: DataFrame, keys: Sequence[str] = KEYS) -> None:
    if not cells.groupBy(*keys, "d").count().where("count > 1").isEmpty():
        raise ValueError("a day occurs twice in a series")


def series_fill(cells: DataFrame, grid: DataFrame, first: int, last: int, max_distance: int, step: int = 1) -> DataFrame:
    """Every day of a range filled for every band and cell from its other days. One shuffle and sort by band and cell serve all frames."""
    return fill_rows(cells, grid.withColumn("d", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step)))), max_distance)


def fill_rows(cells: DataFrame, rows: DataFrame, max_distance: int) -> DataFrame:
    """rows (band, y, x, d) with value, prediction (from the other days within max_distance) and filled."""
    n = checked_window(max_distance)
    own = rows.select("band", "y", "x", "d").withColumn("asked", F.lit(True)).join(cells.select("band", "y", "x", "d", "value"), ["band", "y", "x", "d"], "full")
    over = Window.partitionBy("band", "y", "x").orderBy("d")
    past, future = over.rangeBetween(-n, -1), over.rangeBetween(1, n)
    valid = F.when(F.col("value").isNotNull(), F.col("d"))
    j = own.select("*", F.last("value", True).over(past).alias("vb"), F.max(valid).over(past).alias("db"), F.first("value", True).over(future).alias("va"), F.min(valid).over(future).alias("da")).where("asked")
    p = interpolated(F.col("vb"), F.col("va"), F.col("d") - F.col("db"), F.col("da") - F.col("d"))
    return j.withColumn("prediction", p).select("band", "y", "x", "d", "value", "prediction", F.coalesce("value", "prediction").alias("filled"))


def linear_fit(cells: DataFrame, origin: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Slope and intercept over days since `origin`, r2 and n. Null for less than two days; r2 null where the values do not vary."""
    t = (F.col("d") - origin).cast("double")
    varies = (F.count("value") > 1) & (F.min("d") < F.max("d"))
    g = cells.where("value is not null").groupBy(*keys).agg(
        F.when(varies, F.covar_pop(t, F.col("value")) / F.var_pop(t)).alias("slope"), F.avg(t).alias("mt"), F.avg("value").alias("mv"),
        F.when(varies & (F.min("value") < F.max("value")), F.covar_pop(t, F.col("value")) * F.covar_pop(t, F.col("value")) / (F.var_pop(t) * F.var_pop("value"))).alias("r2"), F.count("value").alias("n"))
    return g.select(*keys, "slope", (F.col("mv") - F.col("slope") * F.col("mt")).alias("intercept"), "r2", "n")


def linear_impute(cells: DataFrame, target: DataFrame, when: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every gap from the linear fit of its other days, however far."""
    fit = linear_fit(cells.where(F.col("d") != when), when, keys)
    return target.join(fit, list(keys), "left").select(*target.columns, F.col("intercept").alias("prediction"), F.coalesce("observed", "intercept").alias("filled"))


def pass_frames(passes: DataFrame, clear: DataFrame, origin: int) -> DataFrame:
    """For each pass of a cell: raw as it was seen (clouds too), what the fit of the clear days gives, and the fit put where the pass is not clear.

    passes and clear: band, y, x, d, value; a cell of too few clear days has no fit.
    """
    p = F.col("slope") * (F.col("d") - origin) + F.col("intercept")
    own = clear.select(*KEYS, "d", F.col("value").alias("_clear"))
    j = passes.select(*KEYS, "d", F.col("value").alias("raw")).join(own, [*KEYS, "d"], "left").join(linear_fit(clear, origin), list(KEYS), "left")
    return j.select(*KEYS, "d", "raw", p.alias("imputed"), F.coalesce("_clear", p).alias("patched"))


def support_class(cells: DataFrame, grid: DataFrame, when: int) -> DataFrame:
    """Valid days before and after, and the older classes: 2 both, 1 before only, 3 after only, 0 none."""
    g = cells.where("value is not null").groupBy(*KEYS).agg(F.count_if(F.col("d") < when).alias("n_before"), F.count_if(F.col("d") > when).alias("n_after"))
    b, a = F.coalesce("n_before", F.lit(0)).cast("long"), F.coalesce("n_after", F.lit(0)).cast("long")
    kind = F.when((b > 0) & (a > 0), 2).when(b > 0, 1).when(a > 0, 3).otherwise(0)
    return grid.join(g, list(KEYS), "left").select(*KEYS, b.alias("n_before"), a.alias("n_after"), kind.alias("support_class"))
