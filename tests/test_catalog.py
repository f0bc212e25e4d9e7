"""Every query of the catalog against its SQL in another engine."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from skyweave import catalog

SQL = catalog.oracle_sql()


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def engine(middle):
    con = duckdb.connect()
    for p in Path(middle).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, middle, engine, name):
    df = catalog.queries()[name](spark, middle)
    rows = df.select(*sorted(df.columns)).collect()
    assert rows
    if name not in SQL:
        return
    other = engine.sql(SQL[name])
    assert sorted(other.columns) == sorted(df.columns)
    want = engine.sql(f"SELECT {', '.join(f'"{c}"' for c in sorted(df.columns))} FROM ({SQL[name]})")
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    assert dict(zip(want.columns, map(str, want.types))) == {c: kinds[t] for c, t in df.dtypes}
    assert plain(rows) == plain(want.fetchall())


@pytest.mark.parametrize("name", [n for n in SQL if "round(" in SQL[n]])
def test_nothing_is_rounded_near_a_half(spark, middle, monkeypatch, name):
    """Where a value lies on a half, the order of its sum decides; the places of each query are such that none does."""
    off = lambda c, n=7: F.struct(F.abs(c * 10.0**n - F.floor(c * 10.0**n) - 0.5).alias("from_half"))
    monkeypatch.setattr(catalog, "_r", off)
    df = catalog.queries()[name](spark, middle)
    rounded = [c for c, kind in df.dtypes if kind == "struct<from_half:double>"]
    if rounded:
        assert all(v is None or v > 1e-6 for v in df.agg(*[F.min(f"{c}.from_half") for c in rounded]).first())


#: Queries that need a range of days or years, and the column whose range must reach the scan.
RANGED = {
    "temporal_filled": "ts", "temporal_strict": "ts", "temporal_carry": "ts", "temporal_masked": "ts", "series_fill": "ts", "season_ndvi": "ts", "season_window_ndvi": "ts", "fuse_date": "ts", "focal_mean": "ts", "tiled_focal_mean": "ts", "regrid_sinusoidal": "ts", "holdout_other_day": "ts",
    "bilinear_resample": "l_shipdate", "fusion_single_delta": "l_shipdate", "dual_fusion": "l_shipdate", "adaptive_correction": "l_shipdate", "pipeline_stages": "l_shipdate", "stage_metrics": "l_shipdate", "zonal_sums": "l_shipdate", "moving_window_fit": "l_shipdate",
}


@pytest.mark.parametrize("name", list(RANGED))
def test_ranges_reach_the_scan(spark, middle, capsys, name):
    """Every scan of observations has both ends of the range that the query needs, and few scans there are."""
    catalog.queries()[name](spark, middle).explain("formatted")
    plan = capsys.readouterr().out.split("===== Subqueries")[0]
    scans = [x for x in plan.split("\n\n") if "Location:" in x]
    own = [x for x in scans if RANGED[name] in x]
    assert own and all(f"GreaterThanOrEqual({RANGED[name]}," in x and f"LessThan({RANGED[name]}," in x for x in own)
    assert len(scans) <= 6 and "NestedLoop" not in plan and "Cartesian" not in plan
