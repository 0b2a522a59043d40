"""Comparing a query with its SQL: columns by name, rows in any order."""

import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return round(v, 3) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(df, con, sql):
    got, want = df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    a, b = (sorted((tuple(plain(v) if str(plain(v)) not in ("NaT", "nan", "<NA>") else None for v in r) for r in x[names].astype(object).itertuples(index=False)), key=str) for x in (got, want))
    assert len(a) == len(b)
    assert [str(x) for x in a] == [str(x) for x in b]
