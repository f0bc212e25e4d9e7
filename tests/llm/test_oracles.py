"""The queries that have SQL against another engine."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_operators import MAIL, threads

from skyweave.llm import queries, quotes

SQL = queries.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, middle, name):
    con = duckdb.connect()
    for p in Path(middle).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, middle)
    rows = df.select(*sorted(df.columns)).collect()
    want = con.sql(f"SELECT {', '.join(sorted(df.columns))} FROM ({SQL[name]})")
    assert dict(zip(want.columns, map(str, want.types))) == {c: KINDS[t] for c, t in df.dtypes}
    assert rows and plain(rows) == plain(want.fetchall())


def test_quotes_alike(spark):
    """The tables hold no quoted line, so the SQL of op2 meets generated threads too, with repeated rows and rows without a name."""
    rows = [(c, t, "r", x) for (c, t), (x, _, _) in threads(np.random.default_rng(11)).items()]
    rows += [(c if c is None else c + 100, t, r, x) for c, t, r, x in MAIL] + [(200, t, "r", x) for t, x in enumerate(["A first line. Then (a \"second\" one!) and more.\n\nThe third…  And a fourth", "> Then (a\n> 'second' one!)\nyes ", "x said:\n>> the third\n> A FIRST LINE\nno", "y said:\nno quote", " >\n> \n", "a\r>b\n c "])]
    rows += [(201, 0, "r", "> Then (a second one\n> and a fourth"), (201, None, "r", "> no turn"), rows[5], rows[5], (*rows[6][:3], "> another text\nat the same turn")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    con = duckdb.connect()
    con.register("conversations", frame.toArrow())
    got = quotes.reply_conversations(frame)
    names = ", ".join(sorted(got.columns))
    assert plain(got.select(*sorted(got.columns)).collect()) == plain(con.sql(f"SELECT {names} FROM ({SQL['op2_quotation_linking']})").fetchall())
