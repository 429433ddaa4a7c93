"""Run registered queries next to their SQL in DuckDB and compare rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v: object) -> object:
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(f"{v:.12g}") + 0.0
    return v


def compare(got, want) -> list[str]:
    """Differences between two Arrow tables, order-insensitive, columns by name."""
    problems = []
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"]
    names = sorted(got.column_names)
    for c in names:
        a, b = str(got.schema.field(c).type), str(want.schema.field(c).type)
        norm = {"large_string": "string"}
        if norm.get(a, a) != norm.get(b, b):
            problems.append(f"type of {c}: {a} != {b}")
    if got.num_rows != want.num_rows:
        problems.append(f"rows {got.num_rows} != {want.num_rows}")
    rows = [
        sorted((tuple(_cell(r[c]) for c in names) for r in t.to_pylist()), key=repr) for t in (got, want)
    ]
    bad = [(a, b) for a, b in zip(*rows) if a != b]
    if bad:
        problems.append(f"{len(bad)} differing rows of {names}, e.g. {bad[0][0]} != {bad[0][1]}")
    return problems


def main() -> None:
    from groupaudit.plans.catalog import QUERIES
    from groupaudit.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    names = [n for n in QUERIES if not wanted or any(n.startswith(w) for w in wanted)]
    failed = 0
    for n in names:
        q = QUERIES[n]
        t0 = time.time()
        try:
            got = q.fn(spark, sf_dir).toArrow()
            t1 = time.time()
            if q.sql is None:
                print(f"rows {n} {got.num_rows} rows {t1 - t0:.2f}s {got.slice(0, 2).to_pylist()}"[:600], flush=True)
                continue
            want = con.sql(q.sql).to_arrow_table()
            t2 = time.time()
            problems = compare(got, want)
            if not got.num_rows:
                problems.append("empty")
        except Exception as e:  # report and go on
            problems, t1, t2 = [f"{type(e).__name__}: {str(e)[:900]}"], time.time(), time.time()
        failed += bool(problems)
        if problems:
            print(f"FAIL {n} spark {t1 - t0:.2f}s duck {t2 - t1:.2f}s " + "; ".join(problems), flush=True)
        else:
            print(f"ok   {n} {got.num_rows} rows spark {t1 - t0:.2f}s duck {t2 - t1:.2f}s", flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main()
