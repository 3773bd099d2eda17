"""Compare a registered query with its SQL twin run by DuckDB on the same files.

`python -m tests.oracle [folder] [name ...]` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted_rows(rows, order):
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "float": "FLOAT", "date": "DATE",
}


def difference(df, con, sql: str) -> str | None:
    """None when columns, types and rows agree, otherwise what differs."""
    found = con.execute(sql)
    names, kinds = [c[0] for c in found.description], [str(c[1]) for c in found.description]
    expected = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    ours = dict(df.dtypes)
    wrong = {n: (ours[n], k) for n, k in zip(names, kinds) if _KINDS.get(ours[n], ours[n]) != k}
    if wrong:
        return f"types {wrong}"
    rows = df.collect()
    if len(rows) != len(expected):
        return f"{len(rows)} rows instead of {len(expected)}"
    columns = sorted(names)
    a = _sorted_rows(rows, [df.columns.index(c) for c in columns])
    b = _sorted_rows(expected, [names.index(c) for c in columns])
    for x, y in zip(a, b):
        if x != y:
            return f"row {x} instead of {y} ({sum(p != q for p, q in zip(a, b))} rows differ)"
    return None


def main() -> None:
    from tests.conftest import make_session
    from tunegrain.plans.catalog import QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = make_session(), connect(folder), []
    for name in names:
        start = time.perf_counter()
        try:
            q = QUERIES[name]
            df = q.run(spark, folder)
            result = difference(df, con, q.sql) if q.sql else f"rows only: {len(df.collect())}"
        except Exception as error:  # report and go on with the next query
            result = f"error {type(error).__name__}: {str(error)[:600]}"
        if result and not result.startswith("rows only"):
            bad.append(name)
        print(f"{name:28s} {time.perf_counter() - start:6.2f}s  {result or 'ok'}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
