"""Run the registered queries next to their SQL checks.

    python -m tests.oracle [sf] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]) or str(df[c].dtype) == "Int64":
            df[c] = df[c].astype("float64") + 0.0
    rows = df.astype(object).where(df.notna(), None)
    return rows.sort_values(list(rows.columns), key=lambda s: s.map(repr)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not len(got):
        return "no rows"
    types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns}
    # whole numbers with nulls: doubles from one engine, nullable integers from the other
    wrong = {c: t for c, t in types.items() if t[0] != t[1] and "object" not in t and "str" not in "".join(t) and t != ("float64", "Int64")}
    a, b = canonical(got), canonical(want)
    bad = [c for c in a.columns if not a[c].equals(b[c])]
    if bad:
        rows = a[a[bad].ne(b[bad]).any(axis=1)].index[:4]
        return f"values differ in {bad}:\n{a.loc[rows, a.columns]}\n{b.loc[rows, b.columns]}"
    return f"types differ: {wrong}" if wrong else None


def main() -> int:
    import __spark_entry__ as entry
    from cohortspan.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("oracle", 8)
    con = connect(sf_dir)
    checks = entry.oracle_sql()
    chosen = sys.argv[2:] or list(entry.queries())
    failures = 0
    for name in chosen:
        t0 = time.time()
        try:
            got = entry.queries()[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001 - report and go on
            print(f"ERROR {name}: {str(e)[:1500]}")
            failures += 1
            continue
        t1 = time.time()
        if name not in checks:
            print(f"rows  {name}: {len(got)} rows {t1 - t0:.2f}s")
            continue
        try:
            found = differences(got, con.execute(checks[name]).df())
        except Exception as e:  # noqa: BLE001
            found = f"SQL: {str(e)[:600]}"
        failures += found is not None
        print(f"{'ok   ' if found is None else 'DIFF '} {name}: {len(got)} rows {t1 - t0:.2f}s {found or ''}")
    print("failures", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main())
