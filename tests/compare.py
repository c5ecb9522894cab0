"""Run the registered queries beside their SQL forms in DuckDB.

``python -m tests.compare sf_dir [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(path: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return con


def _norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(round(value, 8) + 0.0)
    return f"{type(value).__name__}:{value}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(_norm(r[i])) for i in order) for r in rows), [columns[i] for i in order]


def check(spark, con, path: str, name: str) -> str | None:
    """None when both sides agree, otherwise what differs."""
    df = entry.queries()[name](spark, path)
    got, columns = _rows(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, expected = _rows(names, cur.fetchall())
    if columns != expected:
        return f"columns {columns} != {expected}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
        return f"{len(bad)} rows differ, first {bad[0]}"
    return None


def main() -> None:
    from basketry.session import build_session

    path, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    failed = 0
    for name in names:
        begun = time.time()
        try:
            problem = check(spark, con, path, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - begun:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main()
