"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return f"D{v}"
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return canonical(df.columns, df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return canonical(columns, cur.fetchall())


def difference(df, con, sql) -> tuple[str | None, int]:
    """None when equal, else a short report; and the number of rows."""
    sc, srows = spark_rows(df)
    dc, drows = duck_rows(con, sql)
    n = sum(srows.values())
    if sc != dc:
        return f"columns {sc} / {dc}", n
    if srows == drows:
        return None, n
    only_s, only_d = srows - drows, drows - srows
    return (
        f"columns {sc}; rows {n} / {sum(drows.values())}; only spark {sum(only_s.values())}: "
        f"{list(only_s)[:3]}; only sql {sum(only_d.values())}: {list(only_d)[:3]}"
    ), n


def type_names(df, con, sql) -> list[str]:
    """Columns whose types differ between the two engines."""
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    same = {
        "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
        "TIMESTAMP": "timestamp_ntz", "DATE": "date", "SMALLINT": "smallint",
    }
    out = []
    for name, dtype, *_ in con.execute(f"DESCRIBE {sql}").fetchall():
        want = same.get(dtype, dtype.lower())
        if spark_types.get(name) != want:
            out.append(f"{name}: spark {spark_types.get(name)} sql {dtype}")
    return out
