"""Rows of a Spark query and of its SQL, as sorted lists of texts."""

import math


def shown(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    return str(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())


def duck_rows(con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall())
