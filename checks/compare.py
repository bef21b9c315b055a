"""Run registered queries next to their SQL and report differences.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from cartwise.session import local_session
from checks.oracle import ORACLE
from checks.queries import REGISTRY

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.astype({c: "float64" for c in df if df[c].dtype.kind in "iuf"}).astype(object).where(df.notna(), None)
    return df.sort_values(list(df.columns), key=lambda s: s.map(repr)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    a, b = ordered(got), ordered(want)
    off = (a.map(repr) != b.map(repr)).any(axis=1)
    return "" if not off.any() else f"{int(off.sum())} rows differ\n{a[off].head(4).to_string()}\n{b[off].head(4).to_string()}"


def main(argv: list[str]) -> None:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(REGISTRY)
    spark, con, bad = local_session("compare"), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            got = REGISTRY[name](spark, sf_dir).toPandas()
            took = time.time() - start
            report = difference(got, con.execute(ORACLE[name]).df()) if name in ORACLE else "no SQL"
        except Exception as e:  # keep going, the others are of interest
            took, report = time.time() - start, f"FAILED {str(e)[:1500]}"
        bad += report not in ("", "no SQL")
        print(f"{name:28s} {took:6.1f}s {len(got):8d} rows  {report or 'equal'}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
