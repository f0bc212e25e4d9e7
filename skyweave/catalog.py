"""Queries over the driver's tables, each with SQL for another engine that must give the same rows.

The events table is a daily cube (target 2024-01-16, windows of five days), the line items a yearly cube of parts (target 1998, reference 1999).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr as X
from .functions import fingerprint, projection
from .operators import areas, correct, focal, fusion, holdout, metrics, mosaic, pyramid, resample, segment, temporal, tiles
from .plans import pipeline, refresh
from .sources import cubes, raster, scenes, shared, zorder

T, N, FIRST = 19738, 5, 19723
KEYS = ["band", "y", "x"]


def _r(c, n: int = 7):
    return F.round(c, n)


class Events:
    """The daily cube of a folder. What needs a few days reads these alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.obs = self.obs_in()
        self.cell = self.cell_in()

    @cached_property
    def shape(self) -> tuple[int, int]:
        return cubes.rows_of(self.spark, self.folder, "events", "user_id", cubes.EVENT_COLUMNS), cubes.EVENT_COLUMNS

    @cached_property
    def grid(self) -> DataFrame:
        return cubes.dense_grid(self.spark, self.shape, cubes.EVENT_BANDS)

    def obs_in(self, first: int | None = None, last: int | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
        return cubes.event_observations(self.spark, self.folder, first, last, rows)

    def cell_in(self, first: int | None = None, last: int | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
        return mosaic.daily_mosaic(self.obs_in(first, last, rows).where(X.cloud_shadow_clear(F.col("qa"))))

    def at(self, d: int, name: str = "observed") -> DataFrame:
        return self.cell_in(d, d).select(*KEYS, F.col("value").alias(name))

    @property
    def target(self) -> DataFrame:
        return self.grid.join(self.at(T), KEYS, "left")

    def filled(self, carry: bool = False) -> DataFrame:
        return temporal.interpolate_on_grid(self.cell_in(T - N, T + N), self.grid, T, N, allow_one_sided=carry)

    @property
    def scored(self) -> DataFrame:
        """The target day predicted from the others, with what was seen as truth and the cloud pattern withheld."""
        held = holdout.holdout(F.col("x"), F.col("y"), 15, 10, "cloud")
        return self.filled(True).select(*KEYS, F.col("observed").alias("truth"), "prediction", held.alias("held"))

    @property
    def scenes(self) -> DataFrame:
        return self.obs.groupBy("day", "d").agg((100 * F.avg((~X.cloud_shadow_clear(F.col("qa"))).cast("double"))).alias("cloud"))

    @property
    def blocks(self) -> DataFrame:
        """The grid with the number of each cell's coarse cell."""
        return self.grid.withColumn("cy", F.expr("cast(y div 5 as int)")).withColumn("cx", F.expr("cast(x div 5 as int)"))

    def coarse_in(self, first: int | None = None, last: int | None = None) -> DataFrame:
        return self.cell_in(first, last).groupBy("band", "d", F.expr("cast(y div 5 as int)").alias("cy"), F.expr("cast(x div 5 as int)").alias("cx")).agg(F.avg("value").alias("value"))


class Parts:
    """The yearly cube of a folder. What needs a few years reads these alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.grid = cubes.part_grid(spark, folder)

    @cached_property
    def coarse_shape(self) -> tuple[int, int]:
        return -(-cubes.rows_of(self.spark, self.folder, "part", "p_partkey", cubes.PART_COLUMNS) // 5), cubes.PART_COLUMNS // 5

    def cell_in(self, first: int, last: int) -> DataFrame:
        return cubes.part_cells(self.spark, self.folder, first, last)

    @property
    def frames(self) -> DataFrame:
        out = temporal.interpolate_on_grid(self.cell_in(1996, 2000), self.grid, 1998, 2, keys=("band", "px"), days={"t1": 1999})
        return out.select("band", "y", "x", "seg", F.col("observed").alias("t0"), "t1", F.col("prediction").alias("l"))

    @property
    def unit(self) -> DataFrame:
        return self.frames.select("band", "y", "x", "seg", *[(F.col(c) / 100000.0).alias(c) for c in ("t0", "t1", "l")])

    def coarse_in(self, first: int, last: int) -> DataFrame:
        own = self.cell_in(first, last).join(self.grid, ["band", "px"])
        return own.groupBy("band", "d", F.expr("cast(y div 5 as int)").alias("cy"), F.expr("cast(x div 5 as int)").alias("cx")).agg((F.avg("value") / 100000.0).alias("value"))

    def sharp_and_coarse(self, fine: int, days: dict[str, int], name: str) -> tuple[DataFrame, DataFrame]:
        """The fine image of a year on the grid, and the coarse images of some years beside each other, from one pass over these years."""
        years = sorted({fine, *days.values()})
        cells = self.cell_in(years[0], years[-1]).where(F.col("d").isin(years))
        one = cells.groupBy("band", "px").agg((F.max(F.when(F.col("d") == fine, F.col("value"))) / 100000.0).alias(name))
        block = cells.join(self.grid, ["band", "px"]).groupBy("band", F.expr("cast(y div 5 as int)").alias("cy"), F.expr("cast(x div 5 as int)").alias("cx")).agg(*[(F.avg(F.when(F.col("d") == d, F.col("value"))) / 100000.0).alias(c) for c, d in days.items()])
        return self.grid.select("band", "px", "y", "x").join(one, ["band", "px"], "left").select(*KEYS, name), block

    def sharp(self, d: int, name: str) -> DataFrame:
        return self.grid.select("band", "px", "y", "x").join(self.cell_in(d, d).select("band", "px", (F.col("value") / 100000.0).alias(name)), ["band", "px"], "left").select(*KEYS, name)

    def block(self, d: int, name: str) -> DataFrame:
        cells = self.grid.select(*KEYS).withColumn("cy", F.expr("cast(y div 5 as int)")).withColumn("cx", F.expr("cast(x div 5 as int)"))
        return cells.join(self.coarse_in(d, d).select("band", "cy", "cx", F.col("value").alias(name)), ["band", "cy", "cx"], "left").select(*KEYS, name)

    @property
    def pair(self) -> DataFrame:
        """The five images of a fusion in one row, from one pass over the cube and one over the blocks."""
        years = lambda d, c: F.max(F.when(F.col("d") == d, F.col("value"))).alias(c)
        sharp = self.cell_in(1996, 2000).groupBy("band", "px").agg(*[(F.max(F.when(F.col("d") == d, F.col("value"))) / 100000.0).alias(c) for d, c in ((1996, "l1"), (1997, "lt"), (2000, "l2"))])
        block = self.coarse_in(1996, 2000).groupBy("band", "cy", "cx").agg(years(1996, "m1"), years(1997, "mt"), years(2000, "m2"))
        cells = self.grid.withColumn("cy", F.expr("cast(y div 5 as int)")).withColumn("cx", F.expr("cast(x div 5 as int)"))
        return cells.join(sharp, ["band", "px"], "left").join(block, ["band", "cy", "cx"], "left").select(*KEYS, "l1", "m1", "l2", "m2", "lt", "mt")


EV = f"""WITH obs AS (SELECT event_id AS source_id, ts, CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INT) AS d, event_type AS band, CAST(user_id // 15 AS INT) AS y, CAST(user_id % 15 AS INT) AS x, CAST(json_extract(props, '$.k') AS INT) AS qa, value AS dn FROM events),
cell AS (SELECT day, d, band, y, x, arg_max(dn, source_id) AS value FROM obs WHERE (qa & 24) = 0 GROUP BY ALL),
grid AS (SELECT band, CAST(i // 15 AS INT) AS y, CAST(i % 15 AS INT) AS x FROM (SELECT unnest(range(0, (max(user_id) // 15 + 1) * 15)) AS i FROM events), (SELECT DISTINCT band FROM obs)),
br AS (SELECT band, y, x, arg_max(value, d) FILTER (d < {T}) AS vb, max(d) FILTER (d < {T}) AS db, arg_min(value, d) FILTER (d > {T}) AS va, min(d) FILTER (d > {T}) AS da FROM cell WHERE abs(d - {T}) BETWEEN 1 AND {N} GROUP BY ALL),
br2 AS (SELECT g.band, g.y, g.x, c.value AS observed, vb, va, {T} - db AS ab, da - {T} AS aa, vb + (CAST({T} - db AS DOUBLE) / (({T} - db) + (da - {T}))) * (va - vb) AS strict FROM grid g LEFT JOIN br USING (band, y, x) LEFT JOIN (SELECT * FROM cell WHERE d = {T}) c USING (band, y, x)),
tmp AS (SELECT *, coalesce(strict, vb, va) AS carry, CAST(CASE WHEN strict IS NOT NULL THEN 1 ELSE 0 END AS INT) AS st0, CAST(CASE WHEN strict IS NOT NULL THEN 1 WHEN vb IS NOT NULL THEN 2 WHEN va IS NOT NULL THEN 3 ELSE 0 END AS INT) AS st FROM br2),
held AS (SELECT DISTINCT y, x, (pow((CAST(x AS DOUBLE)/15-0.49)/0.23, 2) + pow((CAST(y AS DOUBLE)/10-0.51)/0.28, 2) < 1) OR (pow((CAST(x AS DOUBLE)/15-0.65)/0.14, 2) + pow((CAST(y AS DOUBLE)/10-0.40)/0.17, 2) < 1) AS held FROM grid),
sc AS (SELECT t.band, t.y, t.x, observed AS truth, carry AS prediction, held FROM tmp t JOIN held USING (y, x)),
el AS (SELECT *, held AND count(truth) OVER (PARTITION BY y, x) = 5 AS eligible, held AND count(truth) OVER (PARTITION BY y, x) = 5 AND count(prediction) OVER (PARTITION BY y, x) = 5 AS scored FROM sc),
scenes AS (SELECT day, d, 100 * avg(CASE WHEN (qa & 24) = 0 THEN 0.0 ELSE 1.0 END) AS cloud FROM obs GROUP BY ALL)
"""
PT = """WITH src AS (SELECT l_partkey AS px, l_returnflag AS band, CAST(year(l_shipdate) AS INT) AS d, l_orderkey * 10 + l_linenumber AS source_id, max(l_extendedprice) AS dn FROM lineitem GROUP BY ALL),
pcell AS (SELECT px, band, d, arg_max(dn, source_id) AS value FROM src WHERE ((source_id % 10) & 4) = 0 GROUP BY ALL),
pgrid AS (SELECT p_partkey AS px, CAST(p_partkey % 50 AS INT) AS x, CAST(p_partkey // 50 AS INT) AS y, CAST(CASE WHEN p_size = 50 AND p_partkey % 3 = 0 THEN 4 ELSE p_size % 4 END AS INT) AS seg, band FROM part, (SELECT DISTINCT l_returnflag AS band FROM lineitem)),
pbr AS (SELECT band, px, arg_max(value, d) FILTER (d < 1998) AS vb, max(d) FILTER (d < 1998) AS db, arg_min(value, d) FILTER (d > 1998) AS va, min(d) FILTER (d > 1998) AS da FROM pcell WHERE abs(d - 1998) BETWEEN 1 AND 2 GROUP BY ALL),
frames AS (SELECT g.band, g.y, g.x, g.seg, t.value AS t0, r.value AS t1, vb + (CAST(1998 - db AS DOUBLE) / ((1998 - db) + (da - 1998))) * (va - vb) AS l FROM pgrid g LEFT JOIN pbr USING (band, px) LEFT JOIN (SELECT * FROM pcell WHERE d = 1998) t USING (band, px) LEFT JOIN (SELECT * FROM pcell WHERE d = 1999) r USING (band, px)),
unit AS (SELECT band, y, x, seg, t0 / 100000.0 AS t0, t1 / 100000.0 AS t1, l / 100000.0 AS l FROM frames),
safe AS (SELECT band, y, x, seg, t0, t1, coalesce(l, t1) AS l FROM frames),
pc AS (SELECT band, d, CAST(y // 5 AS INT) AS cy, CAST(x // 5 AS INT) AS cx, avg(value) / 100000.0 AS value FROM pcell JOIN pgrid USING (band, px) GROUP BY ALL),
fine AS (SELECT band, d, y, x, value / 100000.0 AS value FROM pcell JOIN pgrid USING (band, px)),
pair AS (SELECT g.band, g.y, g.x, a.value AS l1, b.value AS m1, c.value AS l2, e.value AS m2, f.value AS lt, h.value AS mt FROM pgrid g LEFT JOIN (SELECT * FROM fine WHERE d = 1996) a USING (band, y, x) LEFT JOIN (SELECT * FROM fine WHERE d = 2000) c USING (band, y, x) LEFT JOIN (SELECT * FROM fine WHERE d = 1997) f USING (band, y, x)
 LEFT JOIN (SELECT * FROM pc WHERE d = 1996) b ON b.band = g.band AND b.cy = g.y // 5 AND b.cx = g.x // 5 LEFT JOIN (SELECT * FROM pc WHERE d = 2000) e ON e.band = g.band AND e.cy = g.y // 5 AND e.cx = g.x // 5 LEFT JOIN (SELECT * FROM pc WHERE d = 1997) h ON h.band = g.band AND h.cy = g.y // 5 AND h.cx = g.x // 5)
"""


def _corrected(frames: str, spatial: bool = True) -> str:
    """CTEs gd (by band) and sd (by band and segment) of the correction rules over a table of frames."""
    mg = "avg(t1) FILTER (t0 IS NULL) AS mg, avg(t1) FILTER (t0 IS NOT NULL) AS mc" if spatial else "CAST(NULL AS DOUBLE) AS mg, CAST(NULL AS DOUBLE) AS mc"
    return f""", gm AS (SELECT band, avg(t0) AS mt, avg(l) FILTER (t0 IS NOT NULL) AS ml, {mg} FROM {frames} GROUP BY band),
gd AS (SELECT band, coalesce(mt, 0) - coalesce(ml, 0) AS gt, coalesce(mg - mc, 0) AS gs, coalesce(mg, 0) - coalesce(mc, 0) AS gu FROM gm),
sm AS (SELECT band, seg, count(t0) AS n, avg(t0) AS mt, avg(l) FILTER (t0 IS NOT NULL) AS ml, {mg} FROM {frames} WHERE seg IS NOT NULL GROUP BY ALL),
sd AS (SELECT band, seg, CASE WHEN n >= 30 THEN coalesce(mt - ml, gt) ELSE gt END + coalesce(mg - mc, gu) AS delta FROM sm JOIN gd USING (band))
"""


def _bilinear(year: int, name: str) -> str:
    return f""", o_{name} AS (SELECT * FROM (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)), e_{name} AS (SELECT max(y // 5) AS my, 9 AS mx FROM pgrid),
{name} AS (SELECT g.band, g.y, g.x, CASE WHEN count(c.value) = 4 THEN sum(w * c.value) END AS value FROM (SELECT band, y, x, CASE dy WHEN 1 THEN ((y+0.5)/5-0.5) - floor((y+0.5)/5-0.5) ELSE 1 - (((y+0.5)/5-0.5) - floor((y+0.5)/5-0.5)) END * CASE dx WHEN 1 THEN ((x+0.5)/5-0.5) - floor((x+0.5)/5-0.5) ELSE 1 - (((x+0.5)/5-0.5) - floor((x+0.5)/5-0.5)) END AS w,
 greatest(0, least(floor((y+0.5)/5-0.5) + dy, my)) AS cy, greatest(0, least(floor((x+0.5)/5-0.5) + dx, mx)) AS cx FROM (SELECT band, y, CAST(x AS DOUBLE) AS x FROM pgrid), o_{name}, e_{name}) g LEFT JOIN (SELECT * FROM pc WHERE d = {year}) c ON c.band = g.band AND c.cy = g.cy AND c.cx = g.cx GROUP BY ALL)"""


def _focal(table: str, radius: float, value: str = "value", how: str = "avg", name: str = "foc") -> str:
    values = ", ".join(f"({a}, {b})" for a, b in X.circle_offsets(radius))
    return f", {name} AS (SELECT band, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x, {how}({value}) AS focal FROM {table}, (VALUES {values}) o(dy, dx) WHERE {value} IS NOT NULL GROUP BY ALL)"


def _scores(p: str, t: str) -> str:
    e = f"({p} - {t})"
    return f"""sqrt(avg({e} * {e})) AS rmse, avg(abs({e})) AS mae, avg({e}) AS bias, CASE WHEN count({e}) > 1 AND min({t}) < max({t}) AND min({p}) < max({p}) THEN covar_pop({p}, {t}) / (sqrt(var_pop({p})) * sqrt(var_pop({t}))) END AS pearson_r, CASE WHEN count({e}) > 0 AND min({t}) < max({t}) THEN 1 - sum({e} * {e}) / (count({e}) * var_pop({t})) END AS r2"""


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _events(name: str, query: Callable[[Events], DataFrame], sql: str | None = None) -> None:
    _add(name, lambda spark, folder: query(Events(spark, folder)), sql and EV + sql)


def _parts(name: str, query: Callable[[Parts], DataFrame], sql: str | None = None) -> None:
    _add(name, lambda spark, folder: query(Parts(spark, folder)), sql and PT + sql)


def _rounded(df: DataFrame, *names: str, n: int = 7) -> DataFrame:
    return df.withColumns({c: _r(F.col(c), n) for c in names})


# scans, sources, sinks
_events("scan_scene_filter", lambda e: e.obs_in(FIRST + 5, FIRST + 14).join(e.scenes.where("cloud < 70").select("d"), "d").where(X.within_box(F.col("x"), F.col("y"), 7, 5, 3)).select("source_id", "d", "band", "y", "x", "dn"),
        f"SELECT source_id, d, band, y, x, dn FROM obs JOIN (SELECT d FROM scenes WHERE cloud < 70) USING (d) WHERE d >= {FIRST + 5} AND d < {FIRST + 15} AND abs(x - 7) <= 3 AND abs(y - 5) <= 3")
_events("cloudy_scene", lambda e: _rounded(e.scenes.where("cloud > 60").orderBy("d").limit(1).select("d", "cloud"), "cloud"), "SELECT d, round(cloud, 7) AS cloud FROM scenes WHERE cloud > 60 ORDER BY d LIMIT 1")
_RENAMED = {"view": "SR_B5", "click": "SR_B4", "signup": "SR_B3", "error": "SR_B2"}
_events("coarse_scan_rename", lambda e: e.obs.where(F.col("band").isin(*_RENAMED) & X.coarse_clear(F.col("qa"), F.col("dn") * 10)).select("source_id", "d", F.create_map(*[F.lit(x) for kv in _RENAMED.items() for x in kv])[F.col("band")].alias("band"), "y", "x", "dn"),
        "SELECT source_id, d, CASE band WHEN 'view' THEN 'SR_B5' WHEN 'click' THEN 'SR_B4' WHEN 'signup' THEN 'SR_B3' ELSE 'SR_B2' END AS band, y, x, dn FROM obs WHERE band IN ('view', 'click', 'signup', 'error') AND (qa & 3) = 0 AND (qa & 4) = 0 AND (qa & 768) = 0 AND (qa & 1024) = 0 AND dn * 10 < 1500")


def _sensor(e: Events, name: str, rest: int) -> DataFrame:
    return e.obs.where((F.col("source_id") % 2 == rest) & X.bits_clear(F.col("qa"), 63)).select(F.lit(name).alias("sensor"), "source_id", "ts", "band", "y", "x", X.reflectance(F.col("dn")).alias("value"))


_events("sensor_union", lambda e: _sensor(e, "A", 0).unionByName(_sensor(e, "B", 1)).orderBy("ts", "source_id"), "SELECT CASE WHEN source_id % 2 = 0 THEN 'A' ELSE 'B' END AS sensor, source_id, ts, band, y, x, dn * 0.0000275::DOUBLE + (-0.2)::DOUBLE AS value FROM obs WHERE (qa & 63) = 0")


_ONE = "band = 'view'"  # hardly a cell of the small tables has truth in two bands on one day


def _prepared(e: Events) -> DataFrame:
    sensor = F.when(F.col("source_id") % 2 == 0, "A").otherwise("B")
    both = e.obs.withColumn("sensor", sensor).withColumn("radsat", (F.col("source_id") % 7 == 0).cast("int"))
    return mosaic.prepared(both, ("view", "click"), 24).select("sensor", "source_id", "ts", "band", "y", "x", "value").orderBy("ts", "source_id")


_events("prepared_union", _prepared, ", p AS (SELECT CASE WHEN source_id % 2 = 0 THEN 'A' ELSE 'B' END AS sensor, * FROM obs WHERE band IN ('view', 'click') AND (qa & 24) = 0 AND source_id % 7 <> 0) SELECT sensor, source_id, ts, band, y, x, dn * 0.0000275::DOUBLE + (-0.2)::DOUBLE AS value FROM (SELECT *, list_unique(list(band) OVER (PARTITION BY sensor, d, y, x)) AS n FROM p) WHERE n = 2")
_events("pass_labels", lambda e: e.obs.select("day").distinct().select("day", X.pass_label(F.col("day"), "chip").alias("label")), "SELECT DISTINCT day, 'chip_' || replace(CAST(day AS VARCHAR), '-', '') AS label FROM obs")
_events("report_layers", lambda e: pipeline.report_layers(e.filled(True).where(_ONE), e.scored.where(_ONE).select(*KEYS, "truth", "held")),
        """SELECT t.band, t.y, t.x, coalesce(observed, -9999.0) AS truth, coalesce(observed, -9999.0) AS allowed, coalesce(carry, -9999.0) AS prediction, coalesce(observed, carry, -9999.0) AS filled, coalesce(CASE WHEN held AND count(observed) OVER (PARTITION BY t.y, t.x) = 1 THEN carry - observed END, -9999.0) AS signed_error, CAST(held AS INT) AS holdout,
 CAST((vb IS NOT NULL)::INT + (va IS NOT NULL)::INT AS INT) AS support, st AS status, coalesce(CAST(ab AS DOUBLE), -9999.0) AS before_age, coalesce(CAST(aa AS DOUBLE), -9999.0) AS after_age, CAST(CASE WHEN observed IS NOT NULL THEN 1 WHEN st > 0 THEN st + 1 ELSE 0 END AS INT) AS origin FROM tmp t JOIN held USING (y, x) WHERE t.band = 'view'""")
_events("pixel_trace", lambda e: e.cell.where("y = 5 and x = 7").select("d", "band", "value").orderBy("d", "band"), "SELECT d, band, value FROM cell WHERE y = 5 AND x = 7")

# projection, predicates, quality
_events("qa_strict_scale", lambda e: e.obs.where(X.strict_clear(F.col("qa"), F.lit(0))).select("source_id", X.reflectance(F.col("dn")).alias("value")), "SELECT source_id, dn * 0.0000275::DOUBLE + (-0.2)::DOUBLE AS value FROM obs WHERE (qa & 63) = 0")
_events("qa_cloud_shadow", lambda e: e.obs.where(X.cloud_shadow_clear(F.col("qa"))).select("source_id", "dn"), "SELECT source_id, dn FROM obs WHERE (qa & 24) = 0")
_events("qa_extended", lambda e: e.obs.where(X.extended_clear(F.col("qa"))).select("source_id", "dn"), "SELECT source_id, dn FROM obs WHERE (qa & 30) = 0")
_events("qa_coarse", lambda e: e.obs.where(X.coarse_clear(F.col("qa"), F.col("dn") * 10)).select("source_id", "dn"), "SELECT source_id, dn FROM obs WHERE (qa & 3) = 0 AND (qa & 4) = 0 AND (qa & 768) = 0 AND (qa & 1024) = 0 AND dn * 10 < 1500")


def _wide(e: Events, d: int = T) -> DataFrame:
    return e.cell_in(d, d).groupBy("y", "x").pivot("band", ["view", "click", "signup"]).agg(F.max("value"))


_WIDE = f"wide AS (SELECT y, x, max(value) FILTER (band = 'view') AS \"view\", max(value) FILTER (band = 'click') AS click, max(value) FILTER (band = 'signup') AS signup FROM cell WHERE d = {T} GROUP BY ALL)"


def _guarded(e: Events) -> DataFrame:
    first = lambda b, name: F.max(F.when(F.col("band") == b, F.col("dn"))).alias(name)
    bad = F.max((~X.extended_clear(F.col("qa"))).cast("int")) == 1
    p = e.obs_in(T - 2, T).groupBy("y", "x").agg((first("view", "nir") * 100).alias("nir"), (first("click", "red") * 100).alias("red"), (first("signup", "green") * 100).alias("green"), (bad & (F.count("*") > 2)).alias("bad"), (F.max(F.col("qa").bitwiseAND(F.lit(64))) > 0).alias("water_bit"), F.avg("qa").alias("occurrence"), (F.max(F.col("qa").bitwiseAND(F.lit(8))) > 0).alias("cloud_bit"))
    return focal.water_guarded_mask(p.withColumn("band", F.lit("all")), occurrence=60).select("y", "x", "masked")


_OFF6 = ", ".join(f"({a}, {b})" for a, b in X.circle_offsets(6.0))
_events("water_guarded_mask", _guarded, f""", p AS (SELECT y, x, max(dn) FILTER (band = 'view') * 100 AS nir, max(dn) FILTER (band = 'click') * 100 AS red, max(dn) FILTER (band = 'signup') * 100 AS green, max(CASE WHEN (qa & 30) <> 0 THEN 1 ELSE 0 END) = 1 AND count(*) > 2 AS bad, max(qa & 64) > 0 AS wb, avg(qa) AS occ, max(qa & 8) > 0 AS cb FROM obs WHERE d BETWEEN {T - 2} AND {T} GROUP BY ALL),
grown AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM p, (VALUES {_OFF6}) o(dy, dx) WHERE bad), q AS (SELECT p.*, g.y IS NOT NULL AS near, wb OR occ > 60 OR coalesce(green > nir AND green + nir > 0, false) AS water FROM p LEFT JOIN grown g ON g.y = p.y AND g.x = p.x)
SELECT y, x, ((near OR (coalesce(nir < 12000 AND red < 9000, false) AND NOT water)) AND NOT water) OR cb AS masked FROM q""")
_events("ndvi", lambda e: _wide(e).select("y", "x", X.normalized_difference(F.col("view"), F.col("click")).alias("ndvi")), f", {_WIDE} SELECT y, x, (\"view\" - click) / nullif(\"view\" + click, 0) AS ndvi FROM wide")
_events("ndvi_guarded", lambda e: _wide(e).select("y", "x", X.guarded_difference(X.reflectance(F.col("view")), X.reflectance(F.col("click"))).alias("ndvi")),
        f", {_WIDE}, s AS (SELECT y, x, \"view\" * 0.0000275::DOUBLE + (-0.2)::DOUBLE AS n, click * 0.0000275::DOUBLE + (-0.2)::DOUBLE AS r FROM wide) SELECT y, x, CASE WHEN n IS NOT NULL AND r IS NOT NULL THEN (n - r) / greatest(n + r, 1e-4) END AS ndvi FROM s")
_events("clip_keep_null", lambda e: e.target.select(*KEYS, X.clip(F.col("observed"), 20.0, 100.0).alias("value")), "SELECT band, y, x, CASE WHEN observed IS NOT NULL THEN greatest(20.0, least(100.0, observed)) END AS value FROM tmp")
_events("band_pivot", _wide, f", {_WIDE} SELECT * FROM wide")
_events("fcc_stretch", lambda e: _wide(e).select("y", "x", *[F.floor(X.stretch(F.col(b), lo, hi) * 255).cast("int").alias(c) for b, c, lo, hi in (("view", "red", 10.0, 65.0), ("click", "green", 0.0, 25.0), ("signup", "blue", 0.0, 25.0))]),
        f", {_WIDE} SELECT y, x, CAST(floor(CASE WHEN \"view\" IS NOT NULL THEN greatest(0.0, least(1.0, (\"view\" - 10.0) / 55.0)) END * 255) AS INT) AS red, CAST(floor(CASE WHEN click IS NOT NULL THEN greatest(0.0, least(1.0, click / 25.0)) END * 255) AS INT) AS green, CAST(floor(CASE WHEN signup IS NOT NULL THEN greatest(0.0, least(1.0, signup / 25.0)) END * 255) AS INT) AS blue FROM wide")


def _stage_diff(p: Parts) -> DataFrame:
    both = correct.corrections(p.frames)
    return both.where("t0 is null").select(*KEYS, _r(F.abs(F.col("seg_corrected") - F.col("scene_corrected")), 3).alias("diff"))


_parts("stage_diff", _stage_diff, _corrected("frames") + "SELECT band, y, x, round(abs((l + delta) - (l + (gt + gs))), 3) AS diff FROM frames JOIN gd USING (band) LEFT JOIN sd USING (band, seg) WHERE t0 IS NULL")
_events("chip_filter", lambda e: e.cell.where(X.within_box(F.col("x"), F.col("y"), 7, 5, 2)).select("d", *KEYS, "value"), "SELECT d, band, y, x, value FROM cell WHERE abs(x - 7) <= 2 AND abs(y - 5) <= 2")
_events("circle_gap", lambda e: e.grid.select(*KEYS, X.within_circle(F.col("x"), F.col("y"), 7, 5, 3).alias("gap")), "SELECT band, y, x, (x-7)*(x-7) + (y-5)*(y-5) <= 9 AS gap FROM grid")
_events("ring_filter", lambda e: e.grid.where(X.within_ring(F.col("x"), F.col("y"), 7, 5, 2, 2)).select(*KEYS), "SELECT band, y, x FROM grid WHERE (x-7)*(x-7) + (y-5)*(y-5) > 4 AND (x-7)*(x-7) + (y-5)*(y-5) <= 16")
_parts("crop_mask", lambda p: p.grid.where(F.col("seg").isin(1, 4)).select(*KEYS, "seg"), "SELECT band, y, x, seg FROM pgrid WHERE seg IN (1, 4)")

# joins
_events("reference_anti_join", lambda e: e.cell.join(e.scenes.where(F.col("d") == T).select("d"), "d", "left_anti").select("d", *KEYS, "value"), f"SELECT d, band, y, x, value FROM cell WHERE d <> {T}")
_events("sparse_window", lambda e: e.cell.where(F.abs(F.col("d") - T) >= 10).select("d", *KEYS, "value"), f"SELECT d, band, y, x, value FROM cell WHERE abs(d - {T}) >= 10")
_parts("bilinear_resample", lambda p: _rounded(resample.bilinear(p.coarse_in(1998, 1998), p.grid, 5, p.coarse_shape), "value", n=4), _bilinear(1998, "bl") + " SELECT band, y, CAST(x AS INT) AS x, round(value, 4) AS value FROM bl")
_events("aoi_semi_join", lambda e: e.cell.join(e.grid.where("(x + y) % 4 = 0").select("y", "x").distinct(), ["y", "x"], "left_semi").select("d", *KEYS, "value"), "SELECT d, band, y, x, value FROM cell WHERE (x + y) % 4 = 0")
#: A hook around a bay, with a hole, and an island in that hole; corners lie on no cell's centre.
_AOI = '{"type": "MultiPolygon", "coordinates": [[[[1.2, 0.6], [13.7, 0.9], [13.1, 8.8], [9.4, 9.3], [9.9, 4.2], [6.1, 4.7], [5.7, 9.1], [1.4, 8.6], [1.2, 0.6]], [[2.3, 1.7], [5.2, 1.3], [4.6, 4.1], [2.2, 3.9], [2.3, 1.7]]], [[[2.8, 2.1], [4.3, 2.2], [3.6, 3.3]]]]}'


def _aoi(e: Events) -> DataFrame:
    grid = projection.Grid(projection.Geographic(), (1, 0, 0, 0, 1, 0), e.shape[1], max(1, e.shape[0]))
    area = e.spark.createDataFrame([(0, _AOI)], "area int, geometry string")
    found = areas.spans(area, areas.rings_of(F.col("geometry")), grid)
    return areas.within(e.cell_in(rows=areas.row_range(_AOI, grid)), found, grid).select("d", *KEYS, "value")


def _ring_edges() -> str:
    """The AOI's edges as SQL rows."""
    rings = [ring for polygon in json.loads(_AOI)["coordinates"] for ring in polygon]
    return ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]]))


_CROSSES = "(y1 > y + 0.5::DOUBLE) <> (y2 > y + 0.5::DOUBLE) AND x + 0.5::DOUBLE < (x2 - x1) * (y + 0.5::DOUBLE - y1) / (y2 - y1) + x1"
_events("aoi_polygon", _aoi, f" SELECT d, band, y, x, value FROM cell WHERE (SELECT count(*) FROM (VALUES {_ring_edges()}) e(x1, y1, x2, y2) WHERE {_CROSSES}) % 2 = 1")


def _zones(p: Parts) -> DataFrame:
    """Areas of eight suppliers each, their rings through the suppliers' places in order (they cross themselves), and the sums of the parts within."""
    height = cubes.rows_of(p.spark, p.folder, "part", "p_partkey", cubes.PART_COLUMNS)
    grid = projection.Grid(projection.Geographic(), (1, 0, 0, 0, 1, 0), cubes.PART_COLUMNS, max(1, height))
    key, area = F.col("s_suppkey"), F.expr("s_suppkey div 8")
    x, y = (area * 17) % 50 + ((key * 37) % 120) / 10.0 - 6.0, (area * 29) % height + ((key * 91) % 120) / 10.0 - 6.0
    corners = cubes.read(p.spark, p.folder, "supplier").select(area.alias("area"), key.alias("key"), F.array(x, y).alias("point"))
    own = corners.groupBy("area").agg(F.array_sort(F.collect_list(F.struct("key", "point"))).alias("ring"))
    found = areas.spans(own, F.array(F.col("ring.point")), grid)
    values = p.grid.join(p.cell_in(1998, 1998).select("band", "px", "value"), ["band", "px"])
    return areas.by_area(values, found, grid).groupBy("area", "band").agg(F.count("*").alias("n"), _r(F.sum("value"), 2).alias("total"), F.max("value").alias("most"))


_parts("zonal_sums", _zones, f""", h AS (SELECT max(p_partkey) // 50 + 1 AS h FROM part), c AS (SELECT s_suppkey // 8 AS area, s_suppkey AS k, (s_suppkey // 8 * 17) % 50 + (s_suppkey * 37 % 120) / 10.0::DOUBLE - 6.0::DOUBLE AS cx, (s_suppkey // 8 * 29) % h + (s_suppkey * 91 % 120) / 10.0::DOUBLE - 6.0::DOUBLE AS cy FROM supplier, h),
e AS (SELECT area, cx AS x1, cy AS y1, coalesce(lead(cx) OVER o, first_value(cx) OVER o) AS x2, coalesce(lead(cy) OVER o, first_value(cy) OVER o) AS y2 FROM c WINDOW o AS (PARTITION BY area ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
v AS (SELECT band, y, x, value FROM pcell JOIN pgrid USING (band, px) WHERE d = 1998), met AS (SELECT area, band, y, x, value FROM v JOIN e ON {_CROSSES} GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT area, band, count(*) AS n, round(sum(value), 2) AS total, max(value) AS most FROM met GROUP BY area, band""")
_POINTS = [(y, (3 * y + k) % 15) for y in range(10) for k in (0, 7)]
_events("sample_points", lambda e: e.cell.join(F.broadcast(e.spark.createDataFrame(_POINTS, "y int, x int")), ["y", "x"]).select("d", *KEYS, "value"), f"SELECT d, band, y, x, value FROM cell JOIN (VALUES {', '.join(map(str, _POINTS))}) p(y, x) USING (y, x)")

# aggregation
_events("region_mean", lambda e: e.cell.where(X.within_box(F.col("x"), F.col("y"), 7, 5, 3)).groupBy("band", "d").agg(_r(F.avg("value")).alias("mean")), "SELECT band, d, round(avg(value), 7) AS mean FROM cell WHERE abs(x - 7) <= 3 AND abs(y - 5) <= 3 GROUP BY ALL")
_parts("segment_means", lambda p: p.frames.groupBy("band", "seg").agg(F.count("t0").alias("n"), _r(F.avg("t0"), 5).alias("target_clear"), _r(F.avg(F.when(F.col("t0").isNotNull(), F.col("l"))), 5).alias("baseline_clear"), _r(F.avg(F.when(F.col("t0").isNull(), F.col("t1"))), 5).alias("reference_gap"), _r(F.avg(F.when(F.col("t0").isNotNull(), F.col("t1"))), 5).alias("reference_clear")),
       "SELECT band, seg, count(t0) AS n, round(avg(t0), 5) AS target_clear, round(avg(l) FILTER (t0 IS NOT NULL), 5) AS baseline_clear, round(avg(t1) FILTER (t0 IS NULL), 5) AS reference_gap, round(avg(t1) FILTER (t0 IS NOT NULL), 5) AS reference_clear FROM frames GROUP BY ALL")
_COUNTS = ", oc AS (SELECT g.band, g.y, g.x, count(c.value) AS n FROM grid g LEFT JOIN cell c USING (band, y, x) GROUP BY ALL)"
_events("obs_count", lambda e: mosaic.observation_counts(e.cell, e.grid), _COUNTS + " SELECT band, y, x, n FROM oc")
_events("support_histogram", lambda e: mosaic.support_histogram(mosaic.observation_counts(e.cell, e.grid)), _COUNTS + " SELECT band, n, count(*) AS cells, round(count(*) * 0.0009::DOUBLE, 6) AS area_km2, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY band), 4) AS percent FROM oc GROUP BY band, n")
_events("support_stats", lambda e: mosaic.observation_counts(e.cell, e.grid).groupBy("band").agg(F.min("n").alias("least"), F.max("n").alias("most"), _r(F.avg("n")).alias("mean")), _COUNTS + " SELECT band, min(n) AS least, max(n) AS most, round(avg(n), 7) AS mean FROM oc GROUP BY band")
_FIT = f", fit AS (SELECT band, y, x, count(value) AS n, avg(d - {T}) AS mt, avg(value) AS mv, CASE WHEN min(d) < max(d) THEN covar_pop(value, d - {T}) / var_pop(d - {T}) END AS slope, CASE WHEN min(d) < max(d) AND min(value) < max(value) THEN covar_pop(value, d - {T}) * covar_pop(value, d - {T}) / (var_pop(d - {T}) * var_pop(value)) END AS r2 FROM cell WHERE d <> {T} GROUP BY ALL)"
_events("linear_fit", lambda e: _rounded(_rounded(temporal.linear_fit(e.cell.where(F.col("d") != T), T).select(*KEYS, "slope", "intercept"), "slope"), "intercept", n=6), _FIT + " SELECT band, y, x, round(slope, 7) AS slope, round(mv - slope * mt, 6) AS intercept FROM fit")
_events("fit_matrix", lambda e: _rounded(_rounded(_rounded(temporal.linear_fit(e.cell.where(F.col("d") != T), T), "slope"), "intercept", n=6), "r2", n=5), _FIT + " SELECT band, y, x, round(slope, 7) AS slope, round(mv - slope * mt, 6) AS intercept, round(r2, 5) AS r2, n FROM fit")
_events("cloud_fraction", lambda e: e.scenes.select("d", _r(F.col("cloud")).alias("cloud_percent")), "SELECT d, round(cloud, 7) AS cloud_percent FROM scenes")
_events("clear_fraction_by_day", lambda e: e.obs.groupBy("d", "y", "x").agg(F.bool_and(X.cloud_shadow_clear(F.col("qa"))).alias("c")).groupBy("d").agg(_r(F.avg(F.col("c").cast("double"))).alias("clear_fraction")), "SELECT d, round(avg(CASE WHEN c THEN 1.0 ELSE 0.0 END), 7) AS clear_fraction FROM (SELECT d, y, x, bool_and((qa & 24) = 0) AS c FROM obs GROUP BY ALL) GROUP BY d")
_events("support_class", lambda e: temporal.support_class(e.cell, e.grid, T), f"SELECT g.band, g.y, g.x, count(c.value) FILTER (c.d < {T}) AS n_before, count(c.value) FILTER (c.d > {T}) AS n_after, CAST(CASE WHEN count(c.value) FILTER (c.d < {T}) > 0 AND count(c.value) FILTER (c.d > {T}) > 0 THEN 2 WHEN count(c.value) FILTER (c.d < {T}) > 0 THEN 1 WHEN count(c.value) FILTER (c.d > {T}) > 0 THEN 3 ELSE 0 END AS INT) AS support_class FROM grid g LEFT JOIN cell c USING (band, y, x) GROUP BY ALL")
_events("daily_mosaic", lambda e: e.cell, "SELECT day, d, band, y, x, value FROM cell")
_events("distinct_days", lambda e: e.obs.select("day").distinct(), "SELECT DISTINCT day FROM obs")

# windows, order, top-k, neighbourhoods
_events("quality_mosaic", lambda e: mosaic.quality_mosaic(e.cell, T), f"SELECT band, y, x, value, d FROM (SELECT *, row_number() OVER (PARTITION BY band, y, x ORDER BY abs(d - {T}), d) AS n FROM cell WHERE d <> {T}) WHERE n = 1")
_events("common_support", lambda e: mosaic.common_support(e.cell.where(F.col("band").isin("view", "click")), 2).select("d", *KEYS, "value"), "SELECT d, band, y, x, value FROM (SELECT *, count(value) OVER (PARTITION BY d, y, x) AS n FROM cell WHERE band IN ('view', 'click')) WHERE n = 2")
_SERIES = f""", days AS (SELECT g.band, g.y, g.x, CAST({FIRST} + i AS INT) AS d FROM grid g, range(0, 30) r(i)), own AS (SELECT days.*, c.value, CASE WHEN c.value IS NOT NULL THEN days.d END AS vd FROM days LEFT JOIN cell c USING (band, y, x, d)),
wd AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS vb, max(vd) OVER p AS db, first_value(value IGNORE NULLS) OVER f AS va, min(vd) OVER f AS da FROM own WINDOW p AS (PARTITION BY band, y, x ORDER BY d RANGE BETWEEN {N} PRECEDING AND 1 PRECEDING), f AS (PARTITION BY band, y, x ORDER BY d RANGE BETWEEN 1 FOLLOWING AND {N} FOLLOWING)),
series AS (SELECT *, vb + (CAST(d - db AS DOUBLE) / ((d - db) + (da - d))) * (va - vb) AS prediction FROM wd)"""
_events("series_fill", lambda e: temporal.series_fill(e.cell_in(FIRST - N, FIRST + 29 + N), e.grid, FIRST, FIRST + 29, N), _SERIES + " SELECT band, y, x, d, value, prediction, coalesce(value, prediction) AS filled FROM series")
_events("clearest_scene", lambda e: e.scenes.orderBy("cloud", "d").limit(1).select("d", _r(F.col("cloud")).alias("cloud")), "SELECT d, round(cloud, 7) AS cloud FROM scenes ORDER BY scenes.cloud, d LIMIT 1")
_events("golden_day", lambda e: e.scenes.where("cloud < 100").select("d", _r(F.col("cloud"), 6).alias("cloud_pct")).orderBy("cloud_pct", "d").limit(1), "SELECT d, round(cloud, 6) AS cloud_pct FROM scenes WHERE cloud < 100 ORDER BY 2, 1 LIMIT 1")
_events("sample_pixels", lambda e: segment.sample_pixels(e.grid.select("y", "x").distinct(), 50), " SELECT y, x FROM (SELECT DISTINCT y, x FROM grid) ORDER BY md5(concat_ws(':', y, x)), y, x LIMIT 50")
_AT = f", now AS (SELECT * FROM cell WHERE d = {T})"
_events("focal_mean", lambda e: _rounded(focal.focal(e.cell_in(T, T), 1.5), "focal"), _AT + _focal("now", 1.5) + " SELECT band, y, x, round(focal, 7) AS focal FROM foc")
_events("focal_max", lambda e: focal.focal(e.cell_in(T, T).where("value > 60"), 6.0, "max"), f", now AS (SELECT * FROM cell WHERE d = {T} AND value > 60)" + _focal("now", 6.0, how="max") + " SELECT band, y, x, focal FROM foc")


def _square_sql(radius: int) -> str:
    step = lambda a, b: f", {b} AS (SELECT g.band, g.y, g.x, coalesce(any_value(g.value), avg(n.value)) AS value FROM {a} g LEFT JOIN {a} n ON n.band = g.band AND abs(n.y - g.y) <= {radius} AND abs(n.x - g.x) <= {radius} GROUP BY ALL)"
    return ", s0 AS (SELECT band, y, x, observed AS value FROM tmp)" + step("s0", "s1") + step("s1", "s2") + " SELECT band, y, x, round(value, 7) AS value FROM s2"


_events("focal_square", lambda e: _rounded(focal.fill_square(e.target.select(*KEYS, F.col("observed").alias("value")), 10), "value"), _square_sql(10))


def _fit_pairs(p: Parts) -> DataFrame:
    return p.sharp(1998, "fine").join(p.block(1998, "coarse"), KEYS)


_MOVING = """, fp AS (SELECT g.band, g.y, g.x, f.value AS fine, c.value AS coarse FROM pgrid g LEFT JOIN (SELECT * FROM fine WHERE d = 1998) f USING (band, y, x) LEFT JOIN (SELECT * FROM pc WHERE d = 1998) c ON c.band = g.band AND c.cy = g.y // 5 AND c.cx = g.x // 5),
mv AS (SELECT g.band, g.y, g.x, any_value(g.coarse) AS coarse, count(n.fine) AS n, covar_pop(n.fine, n.coarse) AS cv, var_pop(n.coarse) AS vr, avg(n.fine) AS mf, avg(n.coarse) AS mc FROM fp g LEFT JOIN (SELECT * FROM fp WHERE fine IS NOT NULL AND coarse IS NOT NULL) n ON n.band = g.band AND abs(n.y - g.y) <= 15 AND abs(n.x - g.x) <= 15 GROUP BY g.band, g.y, g.x),
ab AS (SELECT band, y, x, coarse, CASE WHEN n > 1 AND vr > 1e-9 * (vr + mc * mc) THEN cv / vr END AS alpha, mf, mc FROM mv)"""
_parts("moving_window_fit", lambda p: _rounded(focal.moving_fit(_fit_pairs(p), 15).select(*KEYS, "alpha", "beta"), "alpha", "beta", n=3), _MOVING + " SELECT band, y, x, round(alpha, 3) + 0.0 AS alpha, round(mf - alpha * mc, 3) + 0.0 AS beta FROM ab")
_PATCHED = ", pt AS (SELECT band, y, x, observed AS raw, coalesce(observed, carry) AS patched FROM tmp)"


def _patched(e: Events) -> DataFrame:
    return e.filled(True).select(*KEYS, F.col("observed").alias("raw"), F.col("filled").alias("patched"))


_events("edge_blend", lambda e: _rounded(focal.edge_blend(_patched(e)).select(*KEYS, "blended"), "blended", n=9), _PATCHED + _focal("pt", 1.5, "patched") + " SELECT pt.band, pt.y, pt.x, round(coalesce(raw, focal), 9) AS blended FROM pt LEFT JOIN foc USING (band, y, x)")
_events("feather_safe", lambda e: _rounded(focal.feather(_patched(e)).select(*KEYS, "feathered"), "feathered"), _PATCHED + ", mk AS (SELECT band, y, x, CASE WHEN raw IS NULL THEN 0.0 ELSE 1.0 END AS m FROM pt)" + _focal("mk", 5.0, "m") + " SELECT pt.band, pt.y, pt.x, round(coalesce(raw, 0) * CASE WHEN raw IS NULL THEN 0 ELSE focal END + patched * (1 - CASE WHEN raw IS NULL THEN 0 ELSE focal END), 7) AS feathered FROM pt LEFT JOIN foc USING (band, y, x)")

# the same neighbourhoods on tiles: the grids here are small, and so are the tiles
_SIDE = 32
for _name, _tiled in {
    "focal_mean": lambda e: _rounded(tiles.focal(e.cell_in(T, T), 1.5, side=_SIDE), "focal"),
    "focal_max": lambda e: tiles.focal(e.cell_in(T, T).where("value > 60"), 6.0, "max", side=_SIDE),
    "focal_square": lambda e: _rounded(tiles.fill_square(e.target.select(*KEYS, F.col("observed").alias("value")), 10, side=_SIDE), "value"),
    "edge_blend": lambda e: _rounded(tiles.edge_blend(_patched(e), side=_SIDE), "blended", n=9),
    "feather_safe": lambda e: _rounded(tiles.feather(_patched(e), side=_SIDE), "feathered"),
}.items():
    _add(f"tiled_{_name}", lambda spark, folder, f=_tiled: f(Events(spark, folder)), _SQL[_name])
_add("tiled_moving_fit", lambda spark, folder: _rounded(tiles.moving_fit(_fit_pairs(Parts(spark, folder)), 15, side=_SIDE), "alpha", "beta", n=3), _SQL["moving_window_fit"])

# time
_AGES = "CAST(ab AS DOUBLE) AS before_age_days, CAST(aa AS DOUBLE) AS after_age_days, CAST((vb IS NOT NULL)::INT + (va IS NOT NULL)::INT AS INT) AS support_count"
_events("temporal_strict", lambda e: e.filled().select(*KEYS, "prediction", "status"), "SELECT band, y, x, strict AS prediction, st0 AS status FROM tmp")
_events("temporal_carry", lambda e: e.filled(True).select(*KEYS, "prediction", "status"), "SELECT band, y, x, carry AS prediction, st AS status FROM tmp")
_events("temporal_masked", lambda e: temporal.interpolate(e.cell_in(T - N, T + N).withColumn("ok", F.col("value") < 60), e.target, "2024-01-16", N, valid="ok").select(*KEYS, "prediction", "support_count"),
        f", mb AS (SELECT band, y, x, arg_max(value, d) FILTER (d < {T}) AS vb, max(d) FILTER (d < {T}) AS db, arg_min(value, d) FILTER (d > {T}) AS va, min(d) FILTER (d > {T}) AS da FROM cell WHERE value < 60 AND abs(d - {T}) BETWEEN 1 AND {N} GROUP BY ALL) SELECT g.band, g.y, g.x, vb + (CAST({T} - db AS DOUBLE) / (({T} - db) + (da - {T}))) * (va - vb) AS prediction, CAST((vb IS NOT NULL)::INT + (va IS NOT NULL)::INT AS INT) AS support_count FROM grid g LEFT JOIN mb USING (band, y, x)")
_events("compare_results", lambda e: metrics.compare(e.filled(), e.filled(True), KEYS, "prediction", 1e-10), "SELECT band, y, x, strict AS a, carry AS b FROM tmp WHERE (strict IS NULL) <> (carry IS NULL) OR abs(strict - carry) > 1e-10")
_events("temporal_diagnostics", lambda e: e.filled(True).select(*KEYS, "before_age_days", "after_age_days", "support_count", "status"), f"SELECT band, y, x, {_AGES}, st AS status FROM tmp")
_events("temporal_filled", lambda e: e.filled(True), f"SELECT band, y, x, observed, carry AS prediction, coalesce(observed, carry) AS filled, {_AGES}, st AS status, CAST(CASE WHEN observed IS NOT NULL THEN 1 WHEN st > 0 THEN st + 1 ELSE 0 END AS INT) AS filled_origin FROM tmp")
_events("linear_impute", lambda e: _rounded(temporal.linear_impute(e.cell, e.target, T).select(*KEYS, "prediction", "filled"), "prediction", "filled", n=6), _FIT + " SELECT t.band, t.y, t.x, round(mv - slope * mt, 6) AS prediction, round(coalesce(observed, mv - slope * mt), 6) AS filled FROM tmp t LEFT JOIN fit USING (band, y, x)")
# few days give fits with values on a half of any place, so these are moved by a part of the last one first
_OFF = 1.37e-8
_events("pass_frames", lambda e: _rounded(temporal.pass_frames(mosaic.daily_mosaic(e.obs), e.cell, T).withColumns({c: F.col(c) + _OFF for c in ("imputed", "patched")}), "imputed", "patched"),
        _FIT.replace(f" WHERE d <> {T}", "") + f", pass AS (SELECT d, band, y, x, arg_max(dn, source_id) AS raw FROM obs GROUP BY ALL), fr AS (SELECT p.band, p.y, p.x, p.d, raw, slope * (p.d - {T}) + (mv - slope * mt) AS imputed, coalesce(c.value, slope * (p.d - {T}) + (mv - slope * mt)) AS patched FROM pass p LEFT JOIN cell c USING (band, y, x, d) LEFT JOIN fit USING (band, y, x)) SELECT band, y, x, d, raw, round(imputed + {_OFF}::DOUBLE, 7) AS imputed, round(patched + {_OFF}::DOUBLE, 7) AS patched FROM fr")

# correction
_parts("stage_temporal", lambda p: p.frames.select(*KEYS, F.coalesce("t0", "l", "t1").alias("temporal")), "SELECT band, y, x, coalesce(t0, l, t1) AS temporal FROM frames")
_parts("global_correction", lambda p: _rounded(correct.global_correction(p.frames).select(*KEYS, "corrected"), "corrected", n=3), _corrected("frames") + "SELECT band, y, x, round(l + (gt + gs), 3) AS corrected FROM frames JOIN gd USING (band)")
_parts("global_temporal_only", lambda p: _rounded(correct.global_correction(p.frames, "temporal_bias").select(*KEYS, "corrected"), "corrected", n=3), _corrected("frames", False) + "SELECT band, y, x, round(l + gt, 3) AS corrected FROM frames JOIN gd USING (band)")
_parts("adaptive_correction", lambda p: _rounded(correct.adaptive_correction(p.frames).select(*KEYS, "seg", "corrected"), "corrected", n=3), _corrected("frames") + "SELECT band, y, x, seg, round(l + delta, 3) AS corrected FROM frames LEFT JOIN sd USING (band, seg)")
_parts("kmeans_segments", lambda p: segment.kmeans_segments(p.unit.groupBy("y", "x").pivot("band", ["A", "N", "R"]).agg(F.max("t1")), ["A", "N", "R"]))


def _lloyd_sql(rounds: int) -> str:
    far = "(f.f0 - c.f0) * (f.f0 - c.f0) + (f.f1 - c.f1) * (f.f1 - c.f1) + (f.f2 - c.f2) * (f.f2 - c.f2)"
    nearest = lambda cells, r: f"SELECT f.*, (SELECT arg_min(c.i, struct_pack(d := {far}, i := c.i)) FROM c{r} c) AS seg FROM {cells} f"
    steps = "".join(f", a{r} AS MATERIALIZED ({nearest('sm', r)}), c{r + 1} AS MATERIALIZED (SELECT c.i, coalesce(m.f0, c.f0) AS f0, coalesce(m.f1, c.f1) AS f1, coalesce(m.f2, c.f2) AS f2 FROM c{r} c LEFT JOIN (SELECT seg AS i, avg(f0) AS f0, avg(f1) AS f1, avg(f2) AS f2 FROM a{r} GROUP BY seg) m USING (i))" for r in range(rounds))
    return f""", px AS (SELECT y, x, max(t1) FILTER (band = 'A') AS a, max(t1) FILTER (band = 'N') AS n, max(t1) FILTER (band = 'R') AS r FROM unit GROUP BY ALL HAVING a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL),
st AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(n) AS mn, stddev_pop(n) AS sn, avg(r) AS mr, stddev_pop(r) AS sr FROM px), fe AS MATERIALIZED (SELECT y, x, (a - ma) / sa AS f0, (n - mn) / sn AS f1, (r - mr) / sr AS f2 FROM px, st),
sm AS MATERIALIZED (SELECT * FROM fe ORDER BY md5(concat_ws(':', y, x)), y, x LIMIT 5000), od AS (SELECT *, row_number() OVER (ORDER BY f0 + f1 + f2, y, x) - 1 AS nth, count(*) OVER () AS m FROM sm),
c0 AS MATERIALIZED (SELECT i, f0, f1, f2 FROM range(4) t(i) JOIN od ON nth = (2 * i + 1) * m // 8){steps}, c{rounds + 1} AS (SELECT row_number() OVER (ORDER BY f0, f1, f2) - 1 AS i, f0, f1, f2 FROM c{rounds})
SELECT y, x, CAST(seg AS INT) AS seg FROM ({nearest('fe', rounds + 1)})"""


_parts("lloyd_segments", lambda p: segment.lloyd_segments(p.unit.groupBy("y", "x").pivot("band", ["A", "N", "R"]).agg(F.max("t1")), ["A", "N", "R"]), _lloyd_sql(10))
_RING = "(x-25)*(x-25) + (y-20)*(y-20) > 25 AND (x-25)*(x-25) + (y-20)*(y-20) <= 400"
_parts("ring_adaptive", lambda p: _rounded(correct.ring_adaptive(p.frames, X.within_ring(F.col("x"), F.col("y"), 25, 20, 5, 15)).select(*KEYS, "corrected"), "corrected", n=3), f", rd AS (SELECT band, seg, avg(t0) - coalesce(avg(l), 0) AS delta FROM frames WHERE {_RING} AND t0 IS NOT NULL GROUP BY ALL) SELECT band, y, x, round(l + coalesce(delta, 0), 3) AS corrected FROM frames LEFT JOIN rd USING (band, seg)")
_parts("texture_heuristic", lambda p: _rounded(correct.texture_heuristic(p.unit).select(*KEYS, "corrected"), "corrected", n=4), ", th AS (SELECT band, count(t0) AS n, avg(t0) AS mt, avg(l) FILTER (t0 IS NOT NULL) AS ml, avg(t1) FILTER (t0 IS NOT NULL) AS mc FROM unit GROUP BY band), tv AS (SELECT band, y, x, CASE WHEN n > 100 THEN l + (mt - ml) + 0.35::DOUBLE * (t1 - mc) ELSE l END AS v FROM unit JOIN th USING (band)) SELECT band, y, x, round(CASE WHEN v IS NOT NULL THEN greatest(0.0, least(1.0, v)) END, 4) AS corrected FROM tv")
_parts("legacy_spatial_delta", lambda p: _rounded(correct.legacy_spatial_delta(p.frames).select(*KEYS, "corrected"), "corrected", n=5), ", ld AS (SELECT band, seg, avg(t1) FILTER (t0 IS NULL) - avg(t1) FILTER (t0 IS NOT NULL) AS delta FROM frames GROUP BY ALL) SELECT band, y, x, round(l + coalesce(delta, 0), 5) AS corrected FROM frames LEFT JOIN ld USING (band, seg)")
_STAGES = _corrected("safe") + ", st AS (SELECT band, y, x, seg, t0, coalesce(t0, l) AS temporal, coalesce(t0, l + (gt + gs)) AS g, coalesce(t0, l + delta) AS a FROM safe JOIN gd USING (band) LEFT JOIN sd USING (band, seg))" + _focal("st", 1.5, "a")
_parts("pipeline_stages", lambda p: _rounded(pipeline.stages(p.frames).drop("tracker"), "temporal", "global", "adaptive", "blended", n=4), _STAGES + 'SELECT band, y, x, t0 AS broken, round(temporal, 4) AS temporal, round(g, 4) AS "global", round(a, 4) AS adaptive, round(coalesce(t0, focal), 4) AS blended, seg FROM st LEFT JOIN foc USING (band, y, x)')
_parts("fill_tracker", lambda p: p.frames.select(*KEYS, correct.fill_tracker(F.col("t0"), F.coalesce("t0", "l")).alias("tracker")), "SELECT band, y, x, CAST(CASE WHEN t0 IS NOT NULL THEN 0 WHEN l IS NOT NULL THEN 1 ELSE 2 END AS INT) AS tracker FROM frames")

# fusion
_W1, _W2 = fusion.pair_weights(1996, 2000, 1997)
_C = lambda name: F.col(name)
_parts("dual_fusion", lambda p: _rounded(p.pair.select(*KEYS, fusion.dual_residual(_C("l1"), _C("m1"), _C("l2"), _C("m2"), _C("mt"), _W1, _W2).alias("fused")), "fused", n=4), ", v AS (SELECT band, y, x, mt + 0.75::DOUBLE * (l1 - m1) + 0.25::DOUBLE * (l2 - m2) AS v FROM pair) SELECT band, y, x, round(CASE WHEN v IS NOT NULL THEN greatest(0.0, least(1.0, v)) END, 4) AS fused FROM v")
_parts("fusion_single_residual", lambda p: _rounded(p.pair.select(*KEYS, fusion.single_residual(_C("l1"), _C("m1"), _C("mt")).alias("fused")), "fused", n=4), ", v AS (SELECT band, y, x, mt + (l1 - m1) AS v FROM pair) SELECT band, y, x, round(CASE WHEN v IS NOT NULL THEN greatest(0.0, least(1.0, v)) END, 4) AS fused FROM v")

_parts("residual_colour", lambda p: _rounded(p.pair.select(*KEYS, X.residual_colour(_C("l1") - _C("m1")).alias("shade")), "shade", n=3), " SELECT band, y, x, round(CASE WHEN l1 - m1 IS NOT NULL THEN greatest(0.0, least(1.0, (l1 - m1 + 0.15::DOUBLE) / 0.3::DOUBLE)) END, 3) AS shade FROM pair")
_parts("fusion_same_date", lambda p: _rounded(p.pair.select(*KEYS, fusion.single_residual(_C("l1"), _C("m1"), _C("m1")).alias("fused")), "fused"), " SELECT band, y, x, round(CASE WHEN l1 IS NOT NULL AND m1 IS NOT NULL THEN greatest(0.0, least(1.0, l1)) END, 7) AS fused FROM pair")


def _single_delta(p: Parts) -> DataFrame:
    sharp, block = p.sharp_and_coarse(1996, {"mg": 1996, "mt": 1998}, "lg")
    return _rounded(sharp.join(resample.bilinear(block, p.grid, 5, p.coarse_shape, ("mg", "mt")), KEYS).select(*KEYS, fusion.single_delta(_C("lg"), _C("mg"), _C("mt")).alias("fused")), "fused", n=4)


_parts("fusion_single_delta", _single_delta, _bilinear(1996, "b1") + _bilinear(1998, "b2") + " SELECT g.band, g.y, g.x, round(f.value + (b2.value - b1.value), 4) AS fused FROM pgrid g LEFT JOIN (SELECT * FROM fine WHERE d = 1996) f USING (band, y, x) JOIN b1 ON b1.band = g.band AND b1.y = g.y AND b1.x = g.x JOIN b2 ON b2.band = g.band AND b2.y = g.y AND b2.x = g.x")


def _fuse(e: Events) -> DataFrame:
    golden, first, last = T - 6, max(FIRST, T - 6 - N), min(FIRST + 29, T + N)
    return _rounded(fusion.fuse_date(e.cell_in(golden, golden), e.coarse_in(first, last), e.blocks, golden, T, FIRST, FIRST + 29, N, ("band", "cy", "cx")).select(*KEYS, "fused"), "fused")


#: The parts' grid as cells of 30 m in a UTM zone, the events' as cells of 501 m, 16.7 times as wide, on the sphere's sinusoidal plane, its corner 1.7 and 2.3 cells off.
_ZONE, _EAST, _NORTH = projection.utm(33), 520_000.0, 5_205_000.0
_PLANE, _WIDE_STEP, _LEFT, _TOP = projection.Sinusoidal(), 501.0, 1_157_160.0, 5_226_850.0


def _grids(e: Events, p: Parts) -> tuple[projection.Grid, projection.Grid]:
    rows = max(1, cubes.rows_of(p.spark, p.folder, "part", "p_partkey", cubes.PART_COLUMNS))
    return projection.Grid(_PLANE, (_WIDE_STEP, 0, _LEFT, 0, -_WIDE_STEP, _TOP), e.shape[1], max(1, e.shape[0])), projection.Grid(_ZONE, (30, 0, _EAST, 0, -30, _NORTH), cubes.PART_COLUMNS, rows)


def _composite(e: Events, days: dict[str, tuple[int, int]]) -> DataFrame:
    """Means of some ranges of days beside each other, from one pass over all of them."""
    cells = e.cell_in(min(a for a, _ in days.values()), max(b for _, b in days.values()))
    return cells.groupBy("band", F.col("y").alias("cy"), F.col("x").alias("cx")).agg(*[F.avg(F.when(F.col("d").between(*r), F.col("value"))).alias(name) for name, r in days.items()])


def _regrid(e: Events) -> DataFrame:
    coarse, fine = _grids(e, Parts(e.spark, e.folder))
    cells = cubes.dense_grid(e.spark, (fine.height, fine.width), cubes.EVENT_BANDS)
    return _rounded(resample.regrid(_composite(e, {"value": (T - 2 * N, T + 2 * N)}), cells, coarse, fine), "value", n=3)


def _regrid_sql(names: dict[str, tuple[int, int]]) -> str:
    """Fractional places by the projections' formulas, four neighbours each."""
    radius, _, inverse, latitude = _ZONE.series()
    turned = lambda f, g, series, sign, a, b: "".join(f" {sign} {c!r}::DOUBLE * {f}({2 * j} * {a}) * {g}({2 * j} * {b})" for j, c in enumerate(series, 1))
    lat = "".join(f" + {c!r}::DOUBLE * sin({2 * j} * chi)" for j, c in enumerate(latitude, 1))
    means = ", ".join(f"avg(value) FILTER (d BETWEEN {a} AND {b}) AS {n}" for n, (a, b) in names.items())
    mixed = ", ".join(f"CASE WHEN count(c.{n}) = 4 THEN sum(w * c.{n}) END AS {n}" for n in names)
    return f""", co AS (SELECT band, y AS cy, x AS cx, {means} FROM cell GROUP BY ALL), size AS (SELECT max(user_id) // 15 AS my, 14 AS mx FROM events), pr AS (SELECT max(p_partkey) // 50 + 1 AS h FROM part),
f0 AS (SELECT CAST(i // 50 AS INT) AS y, CAST(i % 50 AS INT) AS x FROM (SELECT unnest(range(0, h * 50)) AS i FROM pr)),
f1 AS (SELECT y, x, ({_NORTH} - 30 * (y + 0.5)::DOUBLE) / {0.9996 * radius!r}::DOUBLE AS n, ({_EAST} + 30 * (x + 0.5)::DOUBLE - 500000) / {0.9996 * radius!r}::DOUBLE AS e FROM f0),
f2 AS (SELECT y, x, n{turned("sin", "cosh", inverse, "-", "n", "e")} AS xi, e{turned("cos", "sinh", inverse, "-", "n", "e")} AS eta FROM f1),
f3 AS (SELECT y, x, asin(sin(xi) / cosh(eta)) AS chi, radians({_ZONE.meridian}) + atan2(sinh(eta), cos(xi)) AS lon FROM f2), f4 AS (SELECT y, x, lon, chi{lat} AS lat FROM f3),
f5 AS (SELECT y, x, ({_TOP} - {_PLANE.radius} * lat) / {_WIDE_STEP} - 0.5 AS gy, ({_PLANE.radius} * lon * cos(lat) - {_LEFT}) / {_WIDE_STEP} - 0.5 AS gx FROM f4),
f6 AS (SELECT y, x, CASE dy WHEN 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END * CASE dx WHEN 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END AS w, CASE WHEN gy BETWEEN -0.5 AND my + 0.5 THEN greatest(0, least(floor(gy) + dy, my)) END AS cy, CASE WHEN gx BETWEEN -0.5 AND mx + 0.5 THEN greatest(0, least(floor(gx) + dx, mx)) END AS cx FROM f5, size, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)),
re AS (SELECT b.band, f6.y, f6.x, {mixed} FROM f6 CROSS JOIN (SELECT DISTINCT band FROM obs) b LEFT JOIN co c ON c.band = b.band AND c.cy = f6.cy AND c.cx = f6.cx GROUP BY ALL)"""


_events("regrid_sinusoidal", _regrid, _regrid_sql({"value": (T - 2 * N, T + 2 * N)}) + " SELECT band, y, x, round(value, 3) AS value FROM re")
_PAIR, _ALIKE = {"mg": (T - 2 * N, T - 1), "mt": (T, T + 2 * N)}, {"view": "A", "click": "N", "signup": "R"}


def _fuse_regridded(e: Events) -> DataFrame:
    """Difference transfer onto the fine grid from coarse images of another projection: both composites in one pass, one join."""
    p = Parts(e.spark, e.folder)
    coarse, fine = _grids(e, p)
    alike = F.create_map(*[F.lit(x) for kv in _ALIKE.items() for x in kv])
    both = _composite(e, _PAIR).where(F.col("band").isin(*_ALIKE)).withColumn("band", alike[F.col("band")])
    at = resample.regrid(both, p.grid, coarse, fine, ("mg", "mt"))
    return _rounded(p.sharp(1998, "lg").join(at, KEYS).select(*KEYS, fusion.single_delta(_C("lg"), _C("mg"), _C("mt")).alias("fused")), "fused", n=3)


_add("fuse_regridded", lambda spark, folder: _fuse_regridded(Events(spark, folder)), EV.rstrip() + PT.replace("WITH ", ", ", 1) + _regrid_sql(_PAIR) + f" SELECT g.band, g.y, g.x, round(f.value + (mt - mg), 3) AS fused FROM pgrid g LEFT JOIN (SELECT * FROM fine WHERE d = 1998) f USING (band, y, x) JOIN re ON re.y = g.y AND re.x = g.x AND g.band = CASE re.band {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in _ALIKE.items())} END")


def _fill_sql(t: int, name: str) -> str:
    return f""", b_{name} AS (SELECT band, cy, cx, arg_max(value, d) FILTER (d < {t}) AS vb, max(d) FILTER (d < {t}) AS db, arg_min(value, d) FILTER (d > {t}) AS va, min(d) FILTER (d > {t}) AS da FROM ec WHERE abs(d - {t}) BETWEEN 1 AND {N} GROUP BY ALL),
{name} AS (SELECT g.band, g.cy, g.cx, coalesce(c.value, vb + (CAST({t} - db AS DOUBLE) / ((da - db))) * (va - vb)) AS value FROM (SELECT DISTINCT band, y // 5 AS cy, x // 5 AS cx FROM grid) g LEFT JOIN b_{name} b USING (band, cy, cx) LEFT JOIN (SELECT * FROM ec WHERE d = {t}) c USING (band, cy, cx))"""


_events("fuse_date", _fuse, ", ec AS (SELECT band, d, y // 5 AS cy, x // 5 AS cx, avg(value) AS value FROM cell GROUP BY ALL)" + _fill_sql(T - 6, "mg") + _fill_sql(T, "mt") + f" SELECT g.band, g.y, g.x, round(f.value + (mt.value - mg.value), 7) AS fused FROM grid g LEFT JOIN (SELECT * FROM cell WHERE d = {T - 6}) f USING (band, y, x) JOIN mg ON mg.band = g.band AND mg.cy = g.y // 5 AND mg.cx = g.x // 5 JOIN mt ON mt.band = g.band AND mt.cy = g.y // 5 AND mt.cx = g.x // 5")


def _fused_1999(p: Parts) -> DataFrame:
    return fusion.window_fusion(focal.moving_fit(_fit_pairs(p), 15), p.block(1999, "value"))


def _window_fusion(p: Parts) -> DataFrame:
    return _rounded(_fused_1999(p).select(*KEYS, "fused"), "fused", n=3)


_parts("fusion_window_fit", _window_fusion, _MOVING + " SELECT ab.band, ab.y, ab.x, round(alpha * c.value + (mf - alpha * mc), 3) AS fused FROM ab LEFT JOIN (SELECT * FROM pc WHERE d = 1999) c ON c.band = ab.band AND c.cy = ab.y // 5 AND c.cx = ab.x // 5")
_parts("fusion_window_ndvi", lambda p: _rounded(fusion.fused_index(_fused_1999(p), "A", "R", ["y", "x"]), "ndvi", n=3),
       _MOVING + ", fu AS (SELECT ab.band, ab.y, ab.x, alpha * c.value + (mf - alpha * mc) AS fused FROM ab LEFT JOIN (SELECT * FROM pc WHERE d = 1999) c ON c.band = ab.band AND c.cy = ab.y // 5 AND c.cx = ab.x // 5), w AS (SELECT y, x, max(fused) FILTER (band = 'A') AS a, max(fused) FILTER (band = 'R') AS r FROM fu GROUP BY ALL) SELECT y, x, round((a - r) / nullif(a + r, 0), 3) + 0.0 AS ndvi FROM w")


def _season_window(e: Events) -> DataFrame:
    """Rules of the target day applied to the coarse image of every eighth day."""
    two = F.col("band").isin("view", "click")
    blocks = e.blocks.where(two)
    own = e.coarse_in(T, T).select("band", "cy", "cx", F.col("value").alias("coarse"))
    pairs = blocks.join(e.at(T, "fine"), KEYS, "left").join(own, ["band", "cy", "cx"], "left").select(*KEYS, "fine", "coarse")
    coarse = blocks.join(e.coarse_in(FIRST, FIRST + 29).where((F.col("d") - FIRST) % 8 == 0), ["band", "cy", "cx"]).select(*KEYS, "d", "value")
    fused = fusion.window_fusion(focal.moving_fit(pairs, 15), coarse)
    return _rounded(fusion.fused_index(fused, "view", "click", ["d", "y", "x"]), "ndvi", n=5)


_events("season_window_ndvi", _season_window, f""", ec AS (SELECT band, d, CAST(y // 5 AS INT) AS cy, CAST(x // 5 AS INT) AS cx, avg(value) AS value FROM cell WHERE band IN ('view', 'click') GROUP BY ALL),
fp AS (SELECT g.band, g.y, g.x, f.value AS fine, c.value AS coarse FROM grid g LEFT JOIN (SELECT * FROM cell WHERE d = {T}) f USING (band, y, x) LEFT JOIN (SELECT * FROM ec WHERE d = {T}) c ON c.band = g.band AND c.cy = g.y // 5 AND c.cx = g.x // 5 WHERE g.band IN ('view', 'click')),
""" + _MOVING[_MOVING.index("mv AS"):] + f""", fu AS (SELECT ab.band, ab.y, ab.x, c.d, alpha * c.value + (mf - alpha * mc) AS fused FROM ab JOIN (SELECT * FROM ec WHERE d BETWEEN {FIRST} AND {FIRST + 29} AND (d - {FIRST}) % 8 = 0) c ON c.band = ab.band AND c.cy = ab.y // 5 AND c.cx = ab.x // 5),
w AS (SELECT d, y, x, max(fused) FILTER (band = 'view') AS a, max(fused) FILTER (band = 'click') AS b FROM fu GROUP BY ALL) SELECT d, y, x, round((a - b) / nullif(a + b, 0), 5) + 0.0 AS ndvi FROM w""")


def _season(e: Events) -> DataFrame:
    days = temporal.series_fill(e.cell_in(FIRST - N, FIRST + 29 + N).where(F.col("band").isin("view", "click")), e.grid.where(F.col("band").isin("view", "click")), FIRST, FIRST + 29, N, 8)
    wide = days.groupBy("d", "y", "x").pivot("band", ["view", "click"]).agg(F.max("filled"))
    return _rounded(wide.select("d", "y", "x", X.normalized_difference(F.col("view"), F.col("click")).alias("ndvi")), "ndvi")


_events("season_ndvi", _season, _SERIES + f", w AS (SELECT d, y, x, max(coalesce(value, prediction)) FILTER (band = 'view') AS a, max(coalesce(value, prediction)) FILTER (band = 'click') AS b FROM series WHERE (d - {FIRST}) % 8 = 0 AND band IN ('view', 'click') GROUP BY ALL) SELECT d, y, x, round((a - b) / nullif(a + b, 0), 7) AS ndvi FROM w")


# archives, their index, and what follows from them
def _archive(e: Events) -> str:
    path = shared.new_path(e.spark, "archive")
    scenes.write_archive(e.obs.select("source_id", "d", "band", "y", "x", "dn", "qa"), path, ~X.cloud_shadow_clear(F.col("qa")), tile_rows=8)
    return path


_events("indexed_scenes", lambda e: scenes.read_archive(e.spark, _archive(e), most_cloud=70, days=(FIRST + 5, FIRST + 14), box=(2, 8, 4, 10)).select("source_id", "d", "band", "y", "x", "dn"), _SQL["scan_scene_filter"][len(EV):])
_events("indexed_clearest", lambda e: _rounded(scenes.clearest(scenes.index_of(e.spark, _archive(e))), "cloud"), _SQL["clearest_scene"][len(EV):])


def _refreshed(e: Events) -> DataFrame:
    """A cube built before the observations of some days were all there, or right, or as few, then brought up to them."""
    path, some = shared.new_path(e.spark, "cube"), F.col("d").between(T - 4, T - 1)
    now = e.obs.where(X.cloud_shadow_clear(F.col("qa")) & F.col("dn").isNotNull()).select("source_id", "d", *KEYS, "dn")
    late, wrong, extra = (some & (F.col("source_id") % 10 == k) for k in (3, 5, 7))
    more = now.where(extra).withColumn("source_id", -1 - F.col("source_id")).withColumn("dn", F.col("dn") * 2).withColumn("x", (F.col("x") + 1) % cubes.EVENT_COLUMNS)
    refresh.create(now.where(~late).withColumn("dn", F.when(wrong, F.col("dn") + 1).otherwise(F.col("dn"))).unionByName(more), e.grid, path, FIRST, FIRST + 29, N)
    changes = now.where(late | wrong).withColumn("withdrawn", F.lit(False)).unionByName(more.withColumn("withdrawn", F.lit(True)))
    refresh.refresh(e.spark, path, changes, FIRST, FIRST + 29, N)
    return refresh.filled_series(e.spark, path)


_events("refreshed_cube", _refreshed, _SQL["series_fill"][len(EV):])


def _row_text(columns: dict[str, str]) -> str:
    parts = [f"coalesce('{len(c)}:{c}=' || length({v}) || ':' || {v}, '{len(c)}:{c}=-')" for c, v in sorted(columns.items())]
    return f"md5(concat_ws(';', {', '.join(parts)}))"


def _fingerprint_sql(by: str, table: str, columns: list[str]) -> str:
    digest = _row_text({c: f"CAST({c} AS VARCHAR)" for c in columns})
    sums = ", ".join(f"coalesce(sum(CAST(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT) AS HUGEINT)), 0) AS s{i}" for i in range(4))
    return f"SELECT {by}, n, sha256(concat_ws(':', n, s0, s1, s2, s3)) AS digest FROM (SELECT {by}, count(*) AS n, {sums} FROM (SELECT {by}, {digest} AS h FROM {table}) GROUP BY {by})"


_TABLES = {"events": ["event_id", "ts", "user_id", "event_type", "value", "props"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"], "part": ["p_partkey", "p_size"]}


def _inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of what a run reads, for its record."""
    own = [fingerprint.fingerprint(cubes.read(spark, folder, t), columns=c).select(F.lit(t).alias("name"), "n", "digest") for t, c in _TABLES.items()]
    return own[0].unionByName(own[1]).unionByName(own[2])


_add("input_fingerprints", _inputs, " UNION ALL ".join(f"({_fingerprint_sql('name', f'(SELECT {chr(39)}{t}{chr(39)} AS name, * FROM {t})', c)})" for t, c in _TABLES.items()))
_events("daily_fingerprints", lambda e: fingerprint.fingerprint(e.obs.select("source_id", "d", "band", "y", "x", "qa", "dn"), "d", columns=["source_id", "band", "y", "x", "qa", "dn"]), _fingerprint_sql("d", "obs", ["source_id", "band", "y", "x", "qa", "dn"]))


def _zordered_chip(e: Events) -> DataFrame:
    path = shared.new_path(e.spark, "zordered")
    zorder.write(e.cell.select("d", *KEYS, "value"), path, files=4, within=("band", "d"))
    return zorder.read_box(e.spark, path, (3, 7, 5, 9)).select("d", *KEYS, "value")


_events("zordered_chip", _zordered_chip, _SQL["chip_filter"][len(EV):])
_events("zorder_keys", lambda e: e.grid.select("y", "x").distinct().select("y", "x", zorder.key(F.col("y"), F.col("x")).alias("z")), f"SELECT DISTINCT y, x, CAST(list_sum(list_transform(range(0, 31), lambda i: (((CAST(y AS BIGINT) + {zorder.HALF}) >> i) & 1) * (2::BIGINT << (2 * i)) + (((CAST(x AS BIGINT) + {zorder.HALF}) >> i) & 1) * (1::BIGINT << (2 * i)))) AS BIGINT) AS z FROM grid")


def _rasters(e: Events) -> DataFrame:
    """The days around the target as raster files, one for each day, and read again."""
    path = shared.new_path(e.spark, "rasters")
    days = e.cell_in(T - N, T + N).withColumn("image", X.pass_label(F.col("day"), "cube"))
    raster.write_rasters(days, path, width=e.shape[1], height=max(1, e.shape[0]), bands=list(cubes.EVENT_BANDS), transform=[30, 0, 600_000, 0, -30, 5_000_010], epsg=32633)
    return raster.read_rasters(e.spark, path).where("value is not null")


_events("raster_files", _rasters, f"SELECT 'cube_' || replace(CAST(day AS VARCHAR), '-', '') AS image, band, y, x, value FROM cell WHERE d BETWEEN {T - N} AND {T + N}")


def _levels(e: Events) -> DataFrame:
    return pyramid.build(e.cell, 3, ("band",))


_events("overview_levels", lambda e: _rounded(_levels(e), "total", n=2), ", lv AS (SELECT CAST(k AS INT) AS level, band, CAST(y >> k AS INT) AS y, CAST(x >> k AS INT) AS x, value FROM cell, range(4) r(k) WHERE value IS NOT NULL) SELECT level, band, y, x, round(sum(value), 2) AS total, count(*) AS \"count\", min(value) AS least, max(value) AS most FROM lv GROUP BY ALL")
_events("overview_region", lambda e: _rounded(pyramid.region(_levels(e), (1, 8, 2, 13)).drop("mean"), "total", n=2), "SELECT band, count(value) AS n, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most FROM cell WHERE y BETWEEN 1 AND 8 AND x BETWEEN 2 AND 13 GROUP BY band")

# holdouts and scores
_events("holdout_cloud", lambda e: e.grid.select(*KEYS, holdout.holdout(F.col("x"), F.col("y"), 15, 10, "cloud").alias("held")), "SELECT band, y, x, held FROM grid JOIN held USING (y, x)")
_events("holdout_stripes", lambda e: e.grid.select(*KEYS, holdout.holdout(F.col("x"), F.col("y"), 15, 10, "stripes").alias("held")), "SELECT band, y, x, (x + y // 2) % 10 < 3 AS held FROM grid")
_events("holdout_scene", lambda e: e.grid.select(*KEYS, holdout.holdout(F.col("x"), F.col("y"), 15, 10, "scene").alias("held")), "SELECT band, y, x, true AS held FROM grid")
_events("holdout_diagonal", lambda e: e.grid.select(*KEYS, holdout.diagonal_gap(F.col("x"), F.col("y"), 8, 3, 1).alias("held")), "SELECT band, y, x, (x + y) % 8 <= 3 AS held FROM grid")
_events("holdout_disc", lambda e: e.grid.select(*KEYS, (holdout.disc_gap(F.col("x"), F.col("y"), 15, 10) | holdout.disc_gap(F.col("x"), F.col("y"), 15, 10, 0.22, -2, -3)).alias("held")), "SELECT band, y, x, (y-5)*(y-5) + (x-7)*(x-7) <= 10.24 OR (y-3)*(y-3) + (x-4)*(x-4) <= 4.84 AS held FROM grid")
_events("holdout_other_day", lambda e: holdout.other_day_gap(e.cell_in(T - 1, T - 1), e.grid, T - 1), f"SELECT g.band, g.y, g.x, c.value IS NULL AS held FROM grid g LEFT JOIN (SELECT * FROM cell WHERE d = {T - 1}) c USING (band, y, x)")


def _unit_scores(p: Parts) -> DataFrame:
    held = holdout.holdout(F.col("x"), F.col("y"), 50, 40, "cloud")
    return p.unit.select(*KEYS, F.col("t0").alias("truth"), F.col("l").alias("prediction"), held.alias("held"), F.col("t1").alias("baseline"))


_PHELD = """, ph AS (SELECT band, y, x, t0 AS truth, l AS prediction, t1 AS baseline, (pow((CAST(x AS DOUBLE)/50-0.49)/0.23, 2) + pow((CAST(y AS DOUBLE)/40-0.51)/0.28, 2) < 1) OR (pow((CAST(x AS DOUBLE)/50-0.65)/0.14, 2) + pow((CAST(y AS DOUBLE)/40-0.40)/0.17, 2) < 1) AS held FROM unit),
ps AS (SELECT *, held AND count(truth) OVER (PARTITION BY y, x) = 3 AND count(prediction) OVER (PARTITION BY y, x) = 3 AS scored FROM ph)"""
_parts("score_coverage", lambda p: metrics.coverage(_unit_scores(p), 3), _PHELD + ", n AS (SELECT CAST(count(*) FILTER (held AND t = 3) / 3 AS BIGINT) AS eligible_pixels, CAST(count(*) FILTER (scored) / 3 AS BIGINT) AS scored_pixels FROM (SELECT *, count(truth) OVER (PARTITION BY y, x) AS t FROM ps)) SELECT eligible_pixels, scored_pixels, eligible_pixels - scored_pixels AS unresolved_pixels, CASE WHEN eligible_pixels > 0 THEN CAST(scored_pixels AS DOUBLE) / eligible_pixels END AS coverage_fraction FROM n")
_parts("score_bands", lambda p: _rounded(metrics.band_scores(_unit_scores(p), 3), "rmse", "mae", "bias", "pearson_r", "r2", n=4), _PHELD + f", s AS (SELECT band, CASE WHEN scored THEN prediction END AS p, CASE WHEN scored THEN truth END AS t FROM ps), m AS (SELECT band, {_scores('p', 't')} FROM s GROUP BY band) SELECT band, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(bias, 4) AS bias, round(pearson_r, 4) AS pearson_r, round(r2, 4) AS r2 FROM m")
_events("observed_preserved", lambda e: metrics.violations(e.filled(True)), "SELECT count(*) FILTER (observed IS NOT NULL AND observed IS DISTINCT FROM coalesce(observed, carry)) AS violations FROM tmp")
_parts("benchmark_metrics", lambda p: _rounded(metrics.benchmark(_unit_scores(p)), "rmse", "mae", "r_squared", "reduction_percent", n=3), _PHELD + ", m AS (SELECT band, count(*) AS n, sqrt(avg((prediction-truth)*(prediction-truth))) AS rmse, avg(abs(prediction-truth)) AS mae, CASE WHEN min(truth) < max(truth) AND min(prediction) < max(prediction) THEN pow(covar_pop(prediction, truth), 2) / (var_pop(prediction) * var_pop(truth)) END AS r2, sqrt(avg((prediction-truth)*(prediction-truth)) FILTER (baseline IS NOT NULL)) AS own, sqrt(avg((baseline-truth)*(baseline-truth))) AS base FROM ph WHERE truth > 0 AND prediction IS NOT NULL GROUP BY band) SELECT band, n, round(rmse, 3) AS rmse, round(mae, 3) AS mae, round(r2, 3) AS r_squared, round(CASE WHEN base > 0 THEN 100 * (base - own) / base END, 3) AS reduction_percent FROM m")


def _stage_scores(p: Parts) -> DataFrame:
    """Half of the target withheld in stripes; each stage scored there."""
    held = holdout.holdout(F.col("x"), F.col("y"), 50, 40, "stripes")
    f = p.unit.withColumn("truth", F.col("t0")).withColumn("held", held).withColumn("t0", F.when(~held, F.col("t0"))).withColumn("l", F.coalesce("l", "t1"))
    both = correct.corrections(f).withColumnsRenamed({"scene_corrected": "g", "seg_corrected": "a"})
    return _rounded(metrics.stage_metrics(both, ["l", "g", "a"]), "rmse", "mae", "improvement_percent", n=3)


_parts("stage_metrics", _stage_scores, ", hs AS (SELECT band, y, x, seg, t0 AS truth, (x + y // 2) % 10 < 3 AS held, CASE WHEN NOT ((x + y // 2) % 10 < 3) THEN t0 END AS t0, t1, coalesce(l, t1) AS l FROM unit)" + _corrected("hs") + ", lg AS (SELECT band, truth, held, l, l + (gt + gs) AS g, l + delta AS a FROM hs JOIN gd USING (band) LEFT JOIN sd USING (band, seg)), un AS (SELECT band, 'l' AS stage, l - truth AS e FROM lg WHERE held UNION ALL SELECT band, 'g', g - truth FROM lg WHERE held UNION ALL SELECT band, 'a', a - truth FROM lg WHERE held), m AS (SELECT band, stage, count(e) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM un GROUP BY ALL) SELECT m.band, m.stage, m.n, round(m.rmse, 3) AS rmse, round(m.mae, 3) AS mae, round(CASE WHEN f.rmse > 0 THEN 100 * (f.rmse - m.rmse) / f.rmse END, 3) AS improvement_percent FROM m JOIN (SELECT * FROM m WHERE stage = 'l') f USING (band)")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
