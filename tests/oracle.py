"""Compare every registered query with its SQL counterpart: python -m tests.oracle [folder] [name...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, folder: str, name: str, run, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = run(spark, folder)
    ours = rows_of(df.columns, [tuple(row) for row in df.collect()])
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows / {len(theirs[1])} rows"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            return f"first difference:\n   {a}\n   {b}"
    return None


def main() -> int:
    from tests.conftest import make_session
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = make_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, folder, name, run, oracles[name])
            else:
                problem = None if run(spark, folder).count() else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s"
              + (f"  {problem[:900]}" if problem else ""), flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
