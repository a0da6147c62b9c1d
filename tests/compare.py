"""Compare every query with its SQL, as rows sorted by value with columns sorted by name.

``python tests/compare.py [sf] [query ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402
import pyarrow as pa  # noqa: E402

TESTDATA = Path("/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted((TESTDATA / sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def normalised(table: pa.Table) -> pd.DataFrame:
    """Python values; integers and floats keep their kind, whatever their width."""
    names = sorted(table.column_names)
    rows = zip(*[table.column(n).to_pylist() for n in names])
    return pd.DataFrame(sorted(rows, key=lambda r: tuple(map(repr, r))), columns=names, dtype=object)


def difference(mine: pa.Table, theirs: pa.Table) -> str | None:
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(mine.column_names)} vs {sorted(theirs.column_names)}"
    if mine.num_rows != theirs.num_rows:
        return f"{mine.num_rows} rows vs {theirs.num_rows}"
    a, b = normalised(mine), normalised(theirs)
    for c in a.columns:
        unequal = [(x, y) for x, y in zip(a[c], b[c]) if x != y or type(x) is not type(y)]
        if unequal:
            return f"column {c}: {len(unequal)} values differ, first {unequal[0]!r}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from bench import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    spark = session()
    con = connect(sf)
    sql = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        started = time.time()
        try:
            mine = fn(spark, str(TESTDATA / sf)).toArrow()
            took = time.time() - started
            if name in sql:
                started = time.time()
                problem = difference(mine, con.execute(sql[name]).to_arrow_table())
                print(f"{'ok  ' if problem is None else 'DIFF'} {name} {mine.num_rows} rows, "
                      f"{took:.1f} s, SQL {time.time() - started:.1f} s {problem or ''}", flush=True)
                failed += problem is not None
            else:
                print(f"rows {name} {mine.num_rows} rows, {took:.1f} s", flush=True)
        except Exception as e:  # report and go on with the other queries
            failed += 1
            print(f"FAIL {name} {type(e).__name__} {str(e)[:1500]}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
