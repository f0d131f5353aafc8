"""Compare queries with their SQL on DuckDB; run as a script for a report."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return (1, repr(float(value) + 0.0))
    return (2, str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_plain(r[i]) for i in order) for r in rows])


# Spark type -> DuckDB type, for the types the queries return.
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def compare(df, sql: str, con) -> str | None:
    """None when both agree, else what differs."""
    got_cols, got = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = _rows(names, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} against {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} rows differ, first {bad[0][0]} against {bad[0][1]}"
    for f in df.schema:
        kind = KINDS.get(f.dataType.simpleString())
        if kind is None or kind != kinds[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} against {kinds[f.name]}"
    return None


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry
    from hemline.session import drop_scratch, local_session

    spark = local_session()
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, build in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in oracles:
                problem = compare(df, oracles[name], con)
            else:
                problem = None if df.count() else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.1f}s{'' if name in oracles else ' (rows only)'} {problem or ''}", flush=True)
    drop_scratch(spark)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
