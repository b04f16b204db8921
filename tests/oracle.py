"""A query's rows against its SQL, the way the driver compares them."""

import duckdb

from docweft.sources.tables import SCHEMAS

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(folder):
    con = duckdb.connect()
    for table in SCHEMAS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def check(df, con, sql):
    rows = df.collect()
    cursor = con.execute(sql)
    found = {c[0]: str(c[1]) for c in cursor.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == found
    columns, order = sorted(found), list(found)
    expected = sorted((tuple(r[order.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == expected
    return rows
