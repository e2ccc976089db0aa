"""Run registered checks beside their SQL twins and report differences.

    python -m checks.compare [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for values in frame.itertuples(index=False, name=None):
        row = []
        for value in values:
            if value is None or value is pd.NA or (isinstance(value, float) and value != value):
                row.append("\0")
            elif isinstance(value, float):
                row.append(f"{value:.6f}")
            else:
                row.append(str(value))
        rows.append(tuple(row))
    return sorted(rows)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    from checks.catalog import ORACLES, QUERIES

    started = time.time()
    left_arrow = QUERIES[name](spark, folder).toArrow()
    spent = time.time() - started
    if name not in ORACLES:
        return left_arrow.num_rows > 0, f"rows-only {left_arrow.num_rows} ({spent:.1f}s)"
    right_arrow = con.sql(ORACLES[name]).to_arrow_table()
    kinds_left = {f.name: str(f.type).replace("large_", "") for f in left_arrow.schema}
    kinds_right = {f.name: str(f.type).replace("large_", "") for f in right_arrow.schema}
    note = ""
    if kinds_left != kinds_right:
        note = f" types differ: { {k: (v, kinds_right.get(k)) for k, v in kinds_left.items() if kinds_right.get(k) != v} } {set(kinds_right) - set(kinds_left)}"
        if set(kinds_left) != set(kinds_right):
            return False, note
    left, right = (canonical(t.to_pandas(types_mapper=pd.ArrowDtype)) for t in (left_arrow, right_arrow))
    same = left == right and not note
    detail = f"{len(left)} rows ({spent:.1f}s){note}"
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3]
        only_right = [r for r in right if r not in set(left)][:3]
        detail += f"\n    spark {len(left)} duck {len(right)} {sorted(kinds_left)}\n    only spark: {only_left}\n    only duck: {only_right}"
    return same, detail


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from checks.catalog import QUERIES
    from shelfmark.session import local_session

    spark = local_session()
    con = database(args.sf)
    failed = []
    for name in QUERIES:
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            ok, detail = compare(spark, con, name, args.sf)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, detail = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(("ok  " if ok else "FAIL"), name, detail, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
