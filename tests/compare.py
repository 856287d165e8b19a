"""Run registered queries and their SQL side by side on the same parquet tables.

    python -m tests.compare [--sf 0.01] [--time] [name ...]
"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _kind(series: pd.Series) -> str:
    if series.dtype == object:
        present = series.dropna()
        if len(present) and isinstance(present.iloc[0], bool):
            return "b"
        return "O"
    return {"i": "i", "u": "i", "f": "f", "b": "b", "M": "M"}.get(series.dtype.kind, series.dtype.kind)


def _plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float) and value != value:
        return None
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    return value


def differences(ours: pd.DataFrame, theirs: pd.DataFrame, limit: int = 3) -> list[str]:
    """Exact comparison of column names, kinds, row count and order-free values."""
    problems = []
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"]
    columns = sorted(ours.columns)
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} vs {len(theirs)}")
    for c in columns:
        a, b = _kind(ours[c]), _kind(theirs[c])
        if a != b and len(ours) and not (ours[c].isna().all() and theirs[c].isna().all()):
            problems.append(f"column {c}: kind {ours[c].dtype} vs {theirs[c].dtype}")
    rows = []
    for frame in (ours, theirs):
        values = [tuple(_plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None)]
        rows.append(sorted(values, key=repr))
    bad = [(a, b) for a, b in zip(*rows) if a != b or repr(a) != repr(b)]
    if bad:
        problems.append(f"{len(bad)} of {len(rows[0])} rows differ, e.g. {columns} {bad[:limit]}")
    return problems


def main() -> int:
    from tabloom.plans import all_entries
    from tabloom.session import local_session

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    entries = all_entries()
    names = [n for n in entries if not args or n in args or any(a.endswith("*") and n.startswith(a[:-1]) for a in args) or any(a in entries[n].ops for a in args)]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = []
    for name in names:
        entry = entries[name]
        started = time.time()
        try:
            ours = entry.run(spark, sf_dir).toPandas()
            mid = time.time()
            if entry.sql is None:
                print(f"rows {name} {','.join(entry.ops)}: {len(ours)} rows {mid - started:.1f}s", flush=True)
                if not len(ours):
                    failed.append(name)
                continue
            theirs = con.execute(entry.sql).df()
            problems = differences(ours, theirs)
            if not len(ours):
                problems.append("no rows")
            state = "ok  " if not problems else "FAIL"
            print(f"{state} {name} {','.join(entry.ops)}: {len(ours)} rows {mid - started:.1f}s / {time.time() - mid:.1f}s {problems or ''}", flush=True)
            if problems:
                failed.append(name)
        except Exception as error:  # report and go on with the next query
            failed.append(name)
            text = str(error).strip().splitlines()
            stack = next((i for i, line in enumerate(text) if "Serialization stack" in line), None)
            cause = text[stack - 1 : stack + 12] if stack else []
            print(f"ERR  {name}: {type(error).__name__} {' '.join(text[:6] + cause)[:4000]}", flush=True)
            if "--trace" in sys.argv:
                traceback.print_exc()
    print(f"{len(names)} run, {len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
