"""Run registered queries and their SQL twins side by side and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {"tinyint": "TINYINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def differences(df, con, sql: str) -> list[str]:
    """Human-readable differences in columns, types, row count and values; empty when equal."""
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    got_types = {n: KINDS.get(t, t) for n, t in df.dtypes}
    if set(want_types) != set(got_types):
        return [f"columns {sorted(got_types)} != {sorted(want_types)}"]
    found = [f"type of {c}: {got_types[c]} != {want_types[c]}" for c in got_types if got_types[c] != want_types[c]]
    cols = sorted(got_types)
    got = sorted((tuple(x[c] for c in cols) for x in df.collect()), key=_key)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(x[i] for i in at) for x in rel.fetchall()), key=_key)
    if len(got) != len(want):
        return [*found, f"rows {len(got)} != {len(want)}"]
    bad = [(a, b) for a, b in zip(got, want) if not all(_same(x, y) for x, y in zip(a, b))]
    if bad:
        found.append(f"{len(bad)} rows differ in {cols}, first {bad[0][0]} != {bad[0][1]}")
    return found


def _same(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return x == y or (math.isnan(x) and math.isnan(y))
    return x == y


if __name__ == "__main__":
    import __spark_entry__ as entry
    from foldwright.session import local_session, scratch_run

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = sys.argv[2:]
    spark, con = local_session(8), connect(folder)
    twins = entry.oracle_sql()
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            with scratch_run(spark, "compare"):
                df = run(spark, folder)
                found = differences(df, con, twins[name]) if name in twins else [f"rows only: {df.count()}"]
        except Exception as e:  # report and go on with the next query
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
        print(f"{name:28s} {time.time() - start:6.1f}s  {found or 'equal'}", flush=True)
