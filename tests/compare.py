"""Runs queries against their DuckDB statements and reports differences.

``python tests/compare.py [sf] [name …]``
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    return value


def key(row):
    return tuple((v is not None, type(v).__name__, repr(v)) for v in row)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def compare(df, con, statement: str) -> str | None:
    """None when equal, else what differs."""
    got = df.collect()
    cur = con.execute(statement)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    left, right = rows_of(df.columns, got), rows_of(names, want)
    if len(left) != len(right):
        extra = [r for r in left if r not in set(right)][:2] if len(left) < 5000 else []
        lack = [r for r in right if r not in set(left)][:2] if len(right) < 5000 else []
        return f"{len(left)} rows != {len(right)}; only ours {str(extra)[:400]}; only theirs {str(lack)[:400]}"
    for a, b in zip(left, right, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sorted(names)}\n   ours   {str(a)[:500]}\n   theirs {str(b)[:500]}"
    if not left:
        return "both empty"
    return None


def main() -> int:
    import __spark_entry__ as entry

    from tessera.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = args[1:] or list(queries)
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = None if df.count() else "empty"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        kind = "" if name in oracles else " (no statement)"
        print(f"@@ {mark} {name} {time.time() - start:.1f}s{kind}", problem or "", flush=True)
    print(f"@@ {len(names) - bad} of {len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
