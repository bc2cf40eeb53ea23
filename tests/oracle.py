"""Runs registered queries next to their SQL in DuckDB and compares rows and types.

``python tests/oracle.py [-d DIR] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "smallint": "SMALLINT", "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return str(v)
    return v


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    types = {c[0]: str(c[1]) for c in rel.description}
    if sorted(cols) != names:
        return f"columns: spark {names} sql {sorted(cols)}"
    for f in df.schema:
        want = SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
        if want != types[f.name].replace(" ", "") and want != types[f.name]:
            return f"type of {f.name}: spark {f.dataType.simpleString()} sql {types[f.name]}"
    at = [cols.index(n) for n in names]
    exp = [tuple(_plain(r[i]) for i in at) for r in rel.fetchall()]
    a, b = Counter(got), Counter(exp)
    if a != b:
        return f"rows: spark {len(got)} sql {len(exp)}; only spark {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}"
    return None if got else "EMPTY"


if __name__ == "__main__":
    from tableproof.plans.catalogue import ORACLES, QUERIES
    from tableproof.session import local_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["-d"]:
        sf, args = args[1], args[2:]
    session, duck = local_session(8), connect(sf)
    bad = 0
    for name in args or QUERIES:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(session, duck, QUERIES[name], ORACLES[name], sf)
            else:
                problem = None if QUERIES[name](session, sf).count() else "EMPTY"
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} of {len(args or QUERIES)} failed")
