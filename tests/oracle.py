"""Compares a query with its SQL, rows as multisets."""

import math
import os


def same_text(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{float(v):.9g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


def check(spark, tables, query, sql):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(tables):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tables}/{f}'")
    df = query(spark, tables)
    cols = sorted(df.columns)
    mine = sorted(tuple(map(same_text, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted(tuple(same_text(row[i]) for i in at) for row in r.fetchall())
