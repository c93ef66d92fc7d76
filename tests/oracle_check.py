"""Runs queries and their SQL twins side by side and compares whole results.

python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when equal, else what differs. Values are compared exactly."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = tidy(got), tidy(want)
    for c in a.columns:
        if a[c].dtype == "float64" and b[c].dtype in ("Int32", "Int64"):  # a column of whole numbers and nulls
            b[c] = b[c].astype("float64")
        if a[c].dtype != b[c].dtype:
            return f"{c}: type {a[c].dtype} != {b[c].dtype}"
        off = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if off.any():
            i = off.idxmax()
            return f"{c}: {off.sum()} differ, first {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from logwarden.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con, bad = local_session(), duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            got = queries()[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in oracle_sql():
                start = time.time()
                diff = compare(got, con.sql(oracle_sql()[name]).df())
                note = diff or f"equal, sql {time.time() - start:.1f}s"
                bad += bool(diff)
            else:
                note = "rows only"
            print(f"{'FAIL' if 'equal' not in note and note != 'rows only' else 'ok'} {name} {len(got)} rows {took:.1f}s {note}"[:600], flush=True)
        except Exception as error:
            bad += 1
            print(f"FAIL {name} {type(error).__name__} {str(error)[:700]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
