"""Run registered queries and their SQL side by side: python -m checks.compare <sf_dir> [names]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from checks.oracle import oracle_sql
from checks.queries import queries
from dialoom.session import local_session


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def key(row):
    return tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) else
                 f"{v:.5f}" if isinstance(v, float) else str(v) for v in row)


def difference(spark, con, sf: str, name: str) -> str | None:
    """None when both sides give the same rows; otherwise what differs."""
    frame = queries()[name](spark, sf)
    cols = sorted(frame.columns)
    got = sorted(key(r) for r in frame.select(*cols).collect())
    statement = oracle_sql().get(name)
    if statement is None:
        return None if got else "no rows"
    con.execute(statement)
    kinds = {d[0]: str(d[1]).lower() for d in con.description}
    names = [d[0] for d in con.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    places = [names.index(c) for c in cols]
    want = sorted(key([row[i] for i in places]) for row in con.fetchall())
    kind = {"string": "varchar", "int": "integer"}
    odd = {f.name: (f.dataType.simpleString(), kinds[f.name]) for f in frame.schema
           if kind.get(f.dataType.simpleString(), f.dataType.simpleString()) != kinds[f.name]}
    if odd:
        return f"types {odd}"
    if got == want:
        return None
    a, b = set(got), set(want)
    return f"rows {len(got)} against {len(want)}; only Spark {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}; {len(a - b)}"


def main() -> None:
    sf, names = sys.argv[1], sys.argv[2:] or list(queries())
    spark, con = local_session(), connect(sf)
    for name in names:
        began = time.time()
        try:
            found = difference(spark, con, sf, name)
        except Exception as error:
            found = f"ERROR {str(error)[:400]}"
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - began:.1f}s {found or ''}"[:900], flush=True)


if __name__ == "__main__":
    main()
