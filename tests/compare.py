"""Run a query on Spark and its SQL on DuckDB over the same Parquet files and compare the rows."""

import math
import os
from pathlib import Path

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def duck(sql: str, sf: str = SF):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(sf).glob("*.parquet"):
        source = f"{f}/*.parquet" if f.is_dir() else str(f)
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{source}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
        if type(v).__name__ == "Decimal":
            return f"{float(v):.9g}"
        if isinstance(v, (list, tuple)):
            return [value(x) for x in v]
        return v if v is None or isinstance(v, (int, bool, str)) else str(v)

    def text(v):
        return str(value(v))

    return [names[i] for i in order], sorted([tuple(text(r[i]) for i in order) for r in rows])


def assert_same(frame, sql, sf: str = SF):
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    want = canonical(*duck(sql, sf))
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b, (dict(zip(got[0], a, strict=True)), dict(zip(want[0], b, strict=True)))
