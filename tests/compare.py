"""Run registered queries on Spark and their SQL on DuckDB and compare the results.

``python tests/compare.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> str:
    df = fn(spark, sf_dir)
    names, mine = rows_of(df.columns, df.collect())
    if sql is None:
        return f"rows={len(mine)}"
    cur = con.execute(sql)
    names2, other = rows_of([c[0] for c in cur.description], cur.fetchall())
    if names != names2:
        return f"DIFF columns {names} != {names2}"
    if len(mine) != len(other):
        return f"DIFF rows {len(mine)} != {len(other)}"
    bad = [(a, b) for a, b in zip(mine, other) if a != b]
    types = [(type(x).__name__, type(y).__name__) for a, b in zip(mine[:50], other[:50]) for x, y in zip(a, b) if x is not None and y is not None and type(x) is not type(y)]
    if bad:
        return f"DIFF {len(bad)}/{len(mine)} values, first {bad[0]}"
    if types:
        return f"DIFF types {set(types)}"
    return f"ok rows={len(mine)}"


if __name__ == "__main__":
    from tidepanel.plans import ALL_QUERIES, ALL_SQL
    from tidepanel.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), duck(sf)
    for name, fn in ALL_QUERIES.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            result = compare(spark, con, sf, fn, ALL_SQL.get(name))
        except Exception as exc:  # noqa: BLE001
            result = "ERROR " + str(exc)[:600]
        print(f"{name:28s} {time.time() - start:6.2f}s {result}", flush=True)
