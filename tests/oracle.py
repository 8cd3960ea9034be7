"""Run a registered query in Spark and its checking SQL in DuckDB, and compare the rows."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connection(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, (list, tuple)):
        return repr([_plain(v) for v in value])
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, query, sql):
    """(number of rows, problem or None)."""
    frame = query(spark, folder)
    got = rows_of(frame.columns, frame.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return len(got), f"columns {sorted(frame.columns)} != {sorted(names)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lost = [r for r in want if r not in set(got)][:3]
        return len(got), f"{len(got)} rows != {len(want)} rows; only Spark {extra}; only SQL {lost}"
    return len(got), None
