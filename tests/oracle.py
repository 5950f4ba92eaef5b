"""Compare a query with its SQL as the driver does: by sorted columns and rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "item"):
        return v.item()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def same(spark_rows, names, duck_rows, duck_names):
    a_cols, b_cols = sorted(names), sorted(duck_names)
    assert a_cols == b_cols, (a_cols, b_cols)
    order_a, order_b = [names.index(c) for c in a_cols], [duck_names.index(c) for c in a_cols]
    key = lambda r: tuple(str(x) for x in r)
    a = sorted((tuple(plain(r[i]) for i in order_a) for r in spark_rows), key=key)
    b = sorted((tuple(plain(r[i]) for i in order_b) for r in duck_rows), key=key)
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (len(bad), a_cols, bad[:3])
    return len(a)


def check(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return same(rows, df.columns, found.fetchall(), names)
