"""Run registered queries on Spark and their SQL on DuckDB and compare all rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan") if math.isnan(v) else (2, f"{v + 0.0:.10g}")
    if isinstance(v, int):
        return (2, f"{float(v):.10g}")
    return (3, str(v))


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


# What a column type counts as: whole number, real number, decimal, text, truth, time.
FAMILIES = {
    "whole": ("tinyint", "smallint", "int", "integer", "bigint", "hugeint", "utinyint", "uinteger", "ubigint"),
    "real": ("float", "double"), "text": ("string", "varchar"), "truth": ("boolean",),
    "time": ("timestamp", "timestamp_ntz", "timestamp_ns", "timestamp_us"), "date": ("date",),
}


def family(kind: str) -> str:
    kind = kind.lower()
    return next((f for f, names in FAMILIES.items() if kind in names), kind)


def compare(df, con, sql: str) -> str:
    """Empty text when columns, row counts and values agree, else what differs."""
    left_columns, left = df.columns, df.collect()
    cur = con.execute(sql)
    cur_description = cur.description
    right_columns, right = [d[0] for d in cur_description], cur.fetchall()
    if sorted(left_columns) != sorted(right_columns):
        return f"columns {sorted(left_columns)} against {sorted(right_columns)}"
    spark_kinds = {f.name: family(f.dataType.simpleString()) for f in df.schema.fields}
    other = {c: k for c, k in spark_kinds.items()
             if family(str(dict((d[0], d[1]) for d in cur_description)[c])) != k}
    if other:
        return f"types {other} against {[d[:2] for d in cur_description if d[0] in other]}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    a, b = _rows(left, left_columns), _rows(right, right_columns)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from veilwright.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark, con, sql = local_session(), connect(sf_dir), oracle_sql()
    failures = 0
    for name, job in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                verdict = compare(job(spark, sf_dir), con, sql[name]) or "same"
            else:
                verdict = f"rows {len(job(spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001
            verdict = f"FAILED {type(e).__name__}: {str(e)[:1500]}"
        failures += not (verdict == "same" or verdict.startswith("rows "))
        print(f"{name:45s} {time.time() - start:6.1f}s  {verdict}", flush=True)
    print("failures:", failures)


if __name__ == "__main__":
    main()
